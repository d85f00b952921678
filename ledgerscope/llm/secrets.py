"""Secrets in texts: fixed patterns, and strings that a primed compressor cannot shorten."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from ledgerscope.llm.common import rows, steps, table, texts

#: The base patterns and the least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex")

#: What makes the characters after it sensitive, and how far it reaches.
CONTEXT = re.compile(r"passw|passphrase|pwd|secret|token|credential|authorization|bearer|api.?key|private.?key|access.?key|signature", re.I | re.A)
REACH = 80
RUN, LEAST = re.compile(r"[A-Za-z0-9+/_=-]+"), 16

#: Identifiers that prime the compressor besides the surrounding text.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key client_secret authorization bearer "
    "username email address session cookie signature credential public class static void return import from "
    "function const var let self this none null true false string integer float double boolean list dict map "
    "request response header content type application json http https www example com org net localhost port "
    "config settings environment variable database connection server client timeout version default value name "
    "user_id created_at updated_at get_value set_value is_valid to_string from_string get_token set_password "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ BEGIN END PRIVATE KEY "
)


class Novelty:
    """Marginal compressed bytes of a string given the text around it, under a primed dictionary."""

    def __init__(self, identifiers: str = IDENTIFIERS) -> None:
        primed = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.zstd = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False)

    def marginal(self, before: str, candidate: str, after: str = "") -> int:
        size = lambda x: len(self.zstd.compress(x.encode()))
        return size(before + after + candidate) - size(before + after)


def _classes(s: str) -> int:
    return any(c.islower() for c in s) + any(c.isupper() for c in s) + any(c.isdigit() for c in s)


def find_spans(text: str, novelty: Novelty, bytes_per_char: float = 0.5, surround: int = 256) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Base spans (start, kind number, end) in order, and the novel spans that the method adds; linear in the text and its spans."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    hints = [m.end() for m in CONTEXT.finditer(text)]
    if not hints:
        return base, []
    runs = [m.span() for m in RUN.finditer(text)]
    starts, ends = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))  # of all spans up to each
    novel, done, first = [], 0, 0
    for hint in hints:
        at = max(done, hint)
        while first < len(runs) and runs[first][1] <= at:
            first += 1
        for j in range(first, len(runs)):
            a, b = max(runs[j][0], at), runs[j][1]
            if a > hint + REACH:
                break
            s = text[a:b]
            if b - a < LEAST:
                continue
            done = b
            k = bisect_left(starts, b)
            if _classes(s) < 2 or k and ends[k - 1] > a:
                continue
            if novelty.marginal(text[max(0, a - surround) : a], s, text[b : b + surround]) >= bytes_per_char * len(s):
                novel.append((a, b))
    return base, novel


def _scan(bytes_per_char: float, surround: int):
    def run(batches):
        novelty = Novelty()
        for batch, raw in steps(batches):
            out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel", "found")}
            for t in raw:
                base, novel = find_spans(t.decode("utf-8", "replace"), novelty, bytes_per_char, surround)
                for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                    out[name].append(sum(x[1] == k for x in base))
                said = [(a, k, f"{KINDS[k]}:{a}:{b}") for a, k, b in base]
                out["base_sha256"].append(hashlib.sha256(",".join(x[2] for x in said).encode()).hexdigest())
                said += [(a, 3, f"novel:{a}:{b}") for a, b in novel]
                out["spans"].append(",".join(x[2] for x in sorted(said)))
                out["n_novel"].append(len(novel))
                out["found"].append([{"kind": x.split(":")[0], "start": int(x.split(":")[1]), "end": int(x.split(":")[2])} for _, _, x in sorted(said)])
            found = pa.array(out.pop("found"), pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
            ints = {k: pa.array(v, pa.int64()) for k, v in out.items() if k.startswith("n_")}
            yield rows(batch, ["doc_id"], **ints, base_sha256=pa.array(out["base_sha256"], pa.string()), spans=pa.array(out["spans"], pa.string()), found=found)

    return run


def secret_spans(docs: DataFrame, bytes_per_char: float = 0.5, surround: int = 256) -> DataFrame:
    """One row per document: counts by kind, a digest of the base spans, all spans as text and as structs.

    Spans are of whole matches, in code points, end exclusive. Kinds assign, access and
    hex come from fixed patterns. Kind novel: a string of at least 16 characters of two
    or more sorts (lower, upper, digits), shortly after a sensitive word, outside base
    spans, that costs bytes_per_char or more compressed bytes per character after the
    surround characters on both sides of it, under a dictionary of identifiers. A null or empty
    text has no spans. Repeated rows are reported each; an empty table gives no rows;
    columns but doc_id and text are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs, "doc_id").mapInArrow(
        _scan(bytes_per_char, surround),
        f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_novel bigint, base_sha256 string, spans string, found array<struct<kind:string,start:bigint,end:bigint>>",
    )


def redact(text: str, novelty: Novelty, mark: str = "[REDACTED]") -> str:
    """text with every span, overlapping ones joined, replaced by mark."""
    base, novel = find_spans(text, novelty)
    spans = sorted([(a, b) for a, _, b in base] + novel)
    out, at = [], 0
    for k, (a, b) in enumerate(spans):
        if k and a < at:
            at = max(at, b)
            continue
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """docs with the secrets in text replaced by mark; other columns stay as they are, a null text stays null."""

    def run(batches):
        novelty = Novelty()
        for batch, raw in steps(batches):
            at = batch.schema.get_field_index("text")
            known = batch.column(at).is_valid().to_pylist()
            new = [redact(t.decode("utf-8", "replace"), novelty, mark) if ok else None for t, ok in zip(raw, known, strict=True)]
            yield batch.set_column(at, "text", pa.array(new, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents")).drop("found")
