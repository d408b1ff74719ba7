"""Secret scan with corpus-wide ownership frequency.

Three base patterns find candidate credentials. Their hashes are counted over the whole corpus by
distinct repositories and owners (for documents: a distinct text is a repository, its source the
owner; verbatim copies of a text are one repository with one owner): a value in at most
``max_repositories`` repositories of at most ``max_owners`` owners is owner-specific and looks live,
one that more of either carry is a widely copied example. Values that look live are then
also searched bare, without the keyword that gave them away: those occurrences are the added
spans (kind ``live``); base spans stay whatever the verdict.
"""
from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, small_batches, texts, written

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
#: Maximal runs, so asking for 16 in the pattern drops the same matches as counting afterwards.
HEX = re.compile(rb"[0-9a-f]{16,}")
#: A bare value: a run of the value's characters with a digit and a letter.
BARE = re.compile(rb"[A-Za-z0-9+/_.=-]{12,}")
DIGIT, LETTER = re.compile(rb"[0-9]"), re.compile(rb"[A-Za-z]")
#: A value seen under more owners than this is an example.
MAX_OWNERS = 2
#: A value in more distinct texts than this is an example, even of a single owner: a credential of
#: one owner turns up in a few of its texts, a pasted example in any number.
MAX_REPOSITORIES = 10
#: What makes surroundings: a letter, digit or non-ASCII character.
AROUND = re.compile(rb"[0-9A-Za-z\x80-\xff]")


def base_spans(text: bytes) -> list[tuple[int, int, int, bytes]]:
    """(start, kind, end, value) in bytes, sorted by start and kind; value: what is secret."""
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def _touching(spans: list[tuple[int, int, int, bytes]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the spans with overlaps merged, both ascending."""
    starts, ends = [], []
    for a, _, z, _ in spans:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], z)
        else:
            starts.append(a)
            ends.append(z)
    return starts, ends


def stands_alone(text: bytes, spans: list[tuple[int, int, int, bytes]]) -> bool:
    """Whether nothing but base spans (and punctuation) is in the text."""
    starts, ends = _touching(spans)
    return not any(AROUND.search(text, a, z) for a, z in zip([0, *ends], [*starts, len(text)], strict=True))


def bare_values(text: bytes, spans: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int, bytes]]:
    """(start, end, value) of bare candidate values that touch no base span."""
    starts, ends = _touching(spans)
    out = []
    for m in BARE.finditer(text):
        if DIGIT.search(m[0]) and LETTER.search(m[0]):
            i = bisect_left(starts, m.end()) - 1
            if i < 0 or ends[i] <= m.start():
                out.append((m.start(), m.end(), m[0]))
    return out


def _points(text: bytes, at: list[int]) -> list[int]:
    """Code-point offsets of byte offsets."""
    if text.isascii():
        return at
    known, done, points = {}, 0, 0
    for x in sorted(set(at)):
        points += len(text[done:x].decode("utf-8", "replace"))
        known[x], done = points, x
    return [known[x] for x in at]


def _hash(value: bytes) -> str:
    return hashlib.sha256(value).hexdigest()


_FOUND = ("text_sha256 string, alone boolean, found array<struct<kind:string,start:bigint,end:bigint,hash:string>>")
_FOUND_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.string())]))


def scan(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of docs with text_sha256, alone (see stands_alone) and found: base spans and bare
    candidates (kind bare)."""
    small_batches(docs.sparkSession)
    base = docs.select(*list(dict.fromkeys([*columns, "text"])))
    schema = ", ".join([*(f"`{c}` {base.schema[c].dataType.simpleString()}" for c in columns), _FOUND])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        digests, alone, found = [], [], []
        for t in texts(b):
            spans = base_spans(t)
            bare = bare_values(t, spans)
            at = _points(t, [x for s in spans for x in (s[0], s[2])] + [x for s in bare for x in s[:2]])
            rows = [(KINDS[s[1]], s[3]) for s in spans] + [("bare", s[2]) for s in bare]
            found.append([{"kind": k, "start": at[2 * i], "end": at[2 * i + 1], "hash": _hash(v)} for i, (k, v) in enumerate(rows)])
            digests.append(_hash(t) if rows else None)
            alone.append(stands_alone(t, spans) if spans else False)
        return pa.RecordBatch.from_arrays([b.column(c) for c in columns] + [pa.array(digests, pa.string()), pa.array(alone, pa.bool_()), pa.array(found, _FOUND_ARROW)],
                                          names=[*columns, "text_sha256", "alone", "found"])

    return map_batches(base, run, schema)


def ownership(found: DataFrame, owner: str, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """hash, n_owners, n_repositories, live of every base value.

    A text is one repository however often it is copied, and its owner is the first by name, so a
    text copied under many owners makes no example of its credentials. Only a text that stands
    alone is a repository of each of its owners: nothing in it but the value could tell a copy.
    (hash, repository) is made distinct before it is counted, so a value copied into a third of all
    documents shrinks to its texts and owners first. A null owner is one owner.
    """
    seen = (found.select(F.coalesce(F.col(f"`{owner}`").cast("string"), F.lit("")).alias("owner"), "text_sha256", "alone", F.explode("found").alias("f"))
            .filter("f.kind <> 'bare'").select("f.hash", "owner", "text_sha256", F.when(F.col("alone"), F.col("owner")).alias("own")))
    per_text = seen.groupBy("hash", "text_sha256", "own").agg(F.min("owner").alias("owner"))
    per_owner = per_text.groupBy("hash", "owner").agg(F.count("*").alias("r"))
    return (per_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("r").alias("n_repositories"))
            .withColumn("live", (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories)))


def live_spans(found: DataFrame, owners: DataFrame) -> DataFrame:
    """text_sha256 and live: the bare spans of a text whose value looks live; one row a text."""
    bare = (found.select("text_sha256", F.explode("found").alias("f")).filter("f.kind = 'bare'")
            .select("text_sha256", "f.start", "f.end", "f.hash").distinct())
    return (bare.join(owners.filter("live").select("hash"), "hash", "left_semi")
            .groupBy("text_sha256").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("live")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _in_order(spans: Column) -> Column:
    """By start, then kind as listed."""
    rank = F.lit(len(KINDS))
    return F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"),
        F.when(s["kind"] == "assign", 0).when(s["kind"] == "access", 1).when(s["kind"] == "hex", 2).otherwise(rank).alias("rank"),
        s["kind"].alias("kind"), s["end"].alias("end"))))


def _count(kind: str) -> Column:
    return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op2_secrets(docs: DataFrame, owner: str = "source", max_owners: int = MAX_OWNERS) -> DataFrame:
    """One row a document: base counts, the digest of the base spans, all spans, and how many base
    spans hold live-looking values or widely copied examples.

    Null or empty text has no spans. Repeated rows each get their row. Spans are ordered by start,
    then kind as listed (live last). Very long texts are searched whole, an empty table gives no rows,
    and other columns are not looked at, whatever their names.
    """
    found = written(scan(docs, list(dict.fromkeys(["doc_id", owner]))), "secrets")
    owners = written(ownership(found, owner, max_owners), "secret-owners")
    has = found.filter("size(found) > 0")
    verdict = (has.select("text_sha256", F.explode("found").alias("f")).filter("f.kind <> 'bare'").select("text_sha256", "f.*").distinct()
               .join(owners, "hash").groupBy("text_sha256")
               .agg(F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_example")))
    per_text = verdict.join(live_spans(has, owners), "text_sha256", "full")
    # texts without a span are most of the rows: they take no part in the join
    none = found.filter("size(found) = 0").withColumns({
        "n_live": F.lit(None).cast("long"), "n_example": F.lit(None).cast("long"), "live": F.lit(None).cast("array<struct<start:bigint,end:bigint>>")})
    out = has.join(per_text, "text_sha256", "left").unionByName(none)
    base = F.filter("found", lambda s: s["kind"] != "bare")
    live = F.transform(F.coalesce("live", F.array()), lambda s: F.struct(
        F.lit("live").alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    plain = F.transform(base, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return out.select("doc_id", *[_count(k) for k in KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(_in_order(F.concat(plain, live))).alias("spans"),
                      F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"), F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"))


#: A list of live bare spans up to this many is broadcast; a longer one is joined by shuffle.
BROADCAST_SPANS = 20_000


def redact(docs: DataFrame, owner: str = "source", max_owners: int = MAX_OWNERS, mark: str = "[SECRET]") -> DataFrame:
    """All documents, every base or live span (overlaps merged) of text replaced by ``mark``;
    n_chars, where there is such a column, follows. Texts without spans are unchanged.
    """
    found = written(scan(docs, [owner]).filter("size(found) > 0"), "secrets")
    live = live_spans(found, ownership(found, owner, max_owners))
    if (live.select(F.sum(F.size("live"))).first()[0] or 0) <= BROADCAST_SPANS:
        live = F.broadcast(live)
    names = docs.columns
    at = {c: f"c{i}" for i, c in enumerate(names)}
    copy = docs.select(*[F.col(f"`{c}`").alias(at[c]) for c in names], F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    joined = copy.join(live, "text_sha256", "left").drop("text_sha256")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for t, more in zip(texts(b, at["text"]), b.column("live").to_pylist(), strict=True):
            spans = base_spans(t)
            if not spans and not more:
                out.append(None)
                continue
            byte = [(s[0], s[2]) for s in spans]
            if more:
                bare = bare_values(t, spans)
                known = {m["start"] for m in more}
                byte += [(s[0], s[1]) for s, p in zip(bare, _points(t, [s[0] for s in bare]), strict=True) if p in known]
            parts, end = [], 0
            for a, z in sorted(byte):
                if a >= end:
                    parts += [t[end:a], mark.encode()]
                end = max(end, z)
            out.append(b"".join([*parts, t[end:]]))
        new = pa.array(out, pa.binary()).cast(pa.string())
        cols = []
        for c in names:
            col = b.column(at[c])
            if c == "text":
                col = pc.coalesce(new, col)
            elif c == "n_chars":
                col = pc.coalesce(pc.utf8_length(new).cast(col.type), col)
            cols.append(col)
        return pa.RecordBatch.from_arrays(cols, names=[at[c] for c in names])

    done = map_batches(joined, run, joined.drop("live").schema)
    return done.select(*[F.col(at[c]).alias(c) for c in names])
