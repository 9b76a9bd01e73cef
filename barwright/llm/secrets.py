"""Secret scan with corpus-wide ownership frequency (operator 1).

One pass finds the base kinds and opaque candidates (long mixed tokens that no base span covers).
Every candidate is reduced to a keyed-free SHA-256 prefix; hashes are then counted over distinct
owners and repositories. A value that several owners hold, or that two hold in many repositories, is a
widely copied example; any other that looks random is live-looking, however often its owner repeats it.
Base spans always stay; opaque candidates become spans only where their value is live-looking.

Defined results
    null text          counts as empty: no spans, the digest of the empty string.
    null owner or repo a value of its own ('').
    repeated rows      each row keeps its own result; they add nothing to distinct counts.
    ties               spans are ordered by start, then kind in the order assign, access, hex, opaque.
    empty table        no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import cut, pieces

KINDS = ("assign", "access", "hex", "opaque")
#: The base kinds. ASCII letters only in either case.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: A value held by this many owners or more is a widely copied example.
EXAMPLE_OWNERS = 3
#: ... and so is one of fewer, though two at least, that so many repositories hold.
EXAMPLE_REPOS = 8
#: Bits a character from which an owner-specific value looks live.
LIVE_BITS = 3.0

_SCAN = pa.schema([
    ("row_id", pa.int64()), ("doc_id", pa.int64()), ("owner", pa.string()), ("repo", pa.string()),
    ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("base", pa.string()),
    ("found", pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.string()), ("random", pa.bool_())]))),
])
_SCAN_DDL = ("row_id long, doc_id long, owner string, repo string, n_assign long, n_access long, n_hex long, base_sha256 string, "
             "base string, found array<struct<kind:int,start:long,end:long,hash:string,random:boolean>>")


def entropy(value: str) -> float:
    """Bits a character, to nine places, so that the order of the sum doesn't count."""
    n = len(value)
    return round(-sum(k / n * math.log2(k / n) for k in Counter(value).values()), 9) if n else 0.0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def opaque_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Long tokens with letters and digits that touch no base span."""
    out, k, reach = [], 0, 0
    for m in OPAQUE.finditer(text):
        while k < len(base) and base[k][0] < m.end():  # bases are in order of start
            reach = max(reach, base[k][2])
            k += 1
        v = m[0]
        if reach <= m.start() and any(c.isdigit() for c in v) and any(c.isalpha() for c in v):
            out.append((m.start(), 3, m.end()))
    return out


def _value(text: str, start: int, kind: int, end: int) -> str:
    return ASSIGN.fullmatch(text, start, end)[2] if kind == 0 else text[start:end]


def _named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 40
    for b in pieces(batches):
        rows = []
        for doc, text, owner, repo in zip(*(c.to_pylist() for c in b.columns), strict=True):
            text = text or ""
            base = base_spans(text)
            found = []
            for s, k, e in base + opaque_spans(text, base):
                v = _value(text, s, k, e)
                found.append({"kind": k, "start": s, "end": e, "hash": hashlib.sha256(v.encode()).hexdigest()[:32], "random": entropy(v) >= LIVE_BITS})
            n, named = Counter(k for _, k, _ in base), _named(base)
            rows.append({"row_id": row, "doc_id": doc, "owner": owner or "", "repo": repo or "", "n_assign": n[0], "n_access": n[1], "n_hex": n[2],
                         "base_sha256": hashlib.sha256(named.encode()).hexdigest(), "base": named, "found": found})
            row += 1
        yield pa.RecordBatch.from_pylist(rows, _SCAN)


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_owners, n_repos over distinct owners and repositories. Each step pre-aggregates in the
    map tasks, so a value that a third of all rows hold costs one row for each task and owner."""
    repos = found.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    owners = repos.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return owners.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"))


def scan_secrets(docs: DataFrame, owner: str | None = "source", repo: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """One row for each row of docs: doc_id, counts of the base kinds, base_sha256, spans (base and
    added), n_live and n_example (values that are owner-specific and random, or widely copied), n_owners and
    n_repos (of the value that most owners, and most repositories, hold; 0 without any).

    owner, repo: SQL expressions; repo None takes the owner's."""
    who = owner or "''"
    rows = docs.selectExpr(f"cast({id_col} as bigint) as doc_id", f"{text_col} as text", f"cast({who} as string) as owner", f"cast({repo or who} as string) as repo")
    scan = cut(rows.mapInArrow(_scan, _SCAN_DDL), "secret-scan")
    found = scan.select("row_id", "owner", "repo", F.explode("found").alias("f")).select("row_id", "owner", "repo", "f.*")
    # written before the join, so that both of its sides are plain shuffles and a hot value can be split
    held = cut(ownership(found), "secret-owners", rows=scan.agg(F.sum(F.size("found")).alias("n")).first().n or 0)
    copied = (F.col("n_owners") >= example_owners) | ((F.col("n_owners") > 1) & (F.col("n_repos") >= example_repos))
    marked = (
        found.join(held.hint("merge"), "hash")
        .withColumn("copied", copied)
        .withColumn("live", F.col("random") & ~F.col("copied"))
        .withColumn("span", F.when((F.col("kind") < 3) | F.col("live"), F.struct("start", "kind", "end")))
        .groupBy("row_id")
        .agg(F.array_sort(F.collect_list("span")).alias("spans"), F.count_if("live").alias("n_live"), F.count_if("copied").alias("n_example"), F.max("n_owners").alias("n_owners"), F.max("n_repos").alias("n_repos"))
    )
    kinds = F.array(*[F.lit(k) for k in KINDS])
    named = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))
    return scan.drop("found", "owner", "repo").join(marked, "row_id", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(named, F.lit("")).alias("spans"),
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_live", "n_example", "n_owners", "n_repos")],
    )
