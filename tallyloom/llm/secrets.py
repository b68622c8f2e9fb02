"""Secret scans with corpus-wide ownership frequency.

Three base rules find assignments, access keys and long hexadecimal strings. Besides, every token
that looks random is a candidate. The hashes of all candidates are counted over the corpus by
distinct repositories and owners: a value that many owners hold is a copied example, one that few
hold looks live. Every span, base or not, gets its counts and that class. Tokens that look live, or that a base rule
found as a value elsewhere, are added as spans of kind "owned"; base spans always stay.

Counting goes through two partial aggregates (distinct value and owner, then owners of a value),
so no value's documents are gathered; where documents get the counts back, a value's are dealt over many
tasks. Values travel as 64-bit hashes, never as text.

Defined results: null or empty text has no span; a null repository makes each document its own;
repeated rows get equal results and count once; spans of one start are ordered by kind; offsets are code points
of the text, ends exclusive; a very long text is searched whole; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import batch_of, bytes_of, cut, free_name, key_of, pieces, salted_join, struct, text_of

KINDS = ("assign", "access", "hex", "owned")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
#: What an assignment has in lower case; texts without it are not searched for one.
MARKS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: A value held by more owners or repositories than this is a copied example.
MOST_OWNERS, MOST_REPOS = 2, 3
LEAST_BITS = 3.0

FOUND = "array<struct<kind:int,start:int,stop:int,hash:long>>"
KNOWN = "array<struct<start:int,kind:int,stop:int,hash:bigint,owners:bigint,repos:bigint,live:boolean>>"


def entropy(token: str) -> float:
    """Bits a character."""
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """Base spans and other random-looking tokens: kind, start, end, hash of the value; by start, then kind."""
    found: list[tuple[int, int, int, str]] = []
    lower = text.lower()
    if any(m in lower for m in MARKS):
        found += [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    taken = [(a, b) for _, a, b, _ in found]
    for m in TOKEN.finditer(text):
        token = m[0]
        if token.isalpha() or not any(c.isdigit() for c in token) or not any(c.isalpha() for c in token) or entropy(token) < LEAST_BITS:
            continue
        if not any(a < m.end() and m.start() < b for a, b in taken):
            found.append((3, m.start(), m.end(), token))
    found.sort(key=lambda x: (x[1], x[0]))
    return [(k, a, b, xxhash.xxh3_64_intdigest(v) - (1 << 63)) for k, a, b, v in found]


def owner_of(repo: Column) -> Column:
    """The owner of a repository: what stands before the first slash of its name."""
    return F.substring_index(repo, "/", 1)


def scanned(docs: DataFrame, id_col: str, text_col: str, repo_col: str | None) -> DataFrame:
    """id, key, mark (a hash of the text), repository, and what is found, for each row."""
    repo = F.col(f"`{repo_col}`").cast("string") if repo_col else F.lit(None).cast("string")
    mark = F.xxhash64(bytes_of(text_col), F.lit(1))
    source = docs.select(F.col(f"`{id_col}`").alias("id"), key_of(id_col).alias("key"), mark.alias("mark"), F.coalesce(repo, F.concat(F.lit("\0"), key_of(id_col).cast("string"))).alias("repo"), text_of(text_col).alias("text"))
    schema = source.drop("text").schema.add("found", struct(("x", FOUND))["x"].dataType)

    def run(batches):
        for batch in pieces(batches):
            found = [[dict(zip(("kind", "start", "stop", "hash"), c)) for c in candidates(t)] for t in batch.column(4).to_pylist()]
            yield batch_of({f.name: batch.column(i) for i, f in enumerate(schema) if f.name != "found"} | {"found": found}, schema)

    return source.mapInArrow(run, schema)


def frequencies(found: DataFrame) -> DataFrame:
    """For each hash: distinct repositories and owners, and whether a base rule found it anywhere."""
    each = found.select("repo", F.explode("found").alias("f")).select(F.col("f.hash").alias("hash"), "repo", (F.col("f.kind") < 3).alias("base"))
    by_repo = each.groupBy("hash", "repo").agg(F.max("base").alias("base"))
    by_owner = by_repo.groupBy("hash", owner_of(F.col("repo")).alias("owner")).agg(F.count("*").alias("repos"), F.max("base").alias("base"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.max("base").alias("base"))


def judged(found: DataFrame, most_owners: int, most_repos: int) -> DataFrame:
    """(key, mark, known): each document's distinct spans with owners, repos and whether the value is live; documents without a candidate have no row.

    A value of more than most_owners owners or most_repos repositories is a copied example. A token that no base
    rule found is kept if it is live, or if a base rule found its value elsewhere.
    """
    each = found.select("key", "mark", F.explode("found").alias("f")).distinct().select("key", "mark", "f", F.col("f.hash").alias("hash"))
    live = (F.col("owners") <= most_owners) & (F.col("repos") <= most_repos)
    # a value that a third of all documents hold meets its counts in many tasks
    known = salted_join(each, frequencies(found).withColumn("live", live), "hash").where((F.col("f.kind") < 3) | F.col("base") | F.col("live"))
    span = F.struct(F.col("f.start").alias("start"), F.col("f.kind").alias("kind"), F.col("f.stop").alias("stop"), F.col("f.hash").alias("hash"), "owners", "repos", "live")
    return known.groupBy("key", "mark").agg(F.sort_array(F.collect_list(span)).alias("known"))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str | None = "source", most_owners: int = MOST_OWNERS, most_repos: int = MOST_REPOS) -> DataFrame:
    """For each row: id, n_assign, n_access, n_hex, n_live and n_copied (spans of either class), found.

    found is an array of start, kind, stop, hash, owners, repos and live, by start and then kind: base spans all, and those that
    ownership adds.
    """
    found = cut(scanned(docs, id_col, text_col, repo_col))
    spans = F.coalesce("known", F.array().cast(KNOWN))
    count = lambda test: F.size(F.filter("found", test)).cast("long")
    of_kind = lambda k: count(lambda f: f["kind"] == k)
    rows = found.drop("found").join(judged(found, most_owners, most_repos), ["key", "mark"], "left").withColumn("found", spans)
    return rows.select(
        F.col("id").alias(id_col), *[of_kind(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        count(lambda f: f["live"]).alias("n_live"), count(lambda f: ~f["live"]).alias("n_copied"), "found",
    )


def written(spans: Column, classes: bool = False) -> Column:
    """kind:start:end, joined by commas; with classes also live or copied."""
    kinds = F.array(*map(F.lit, KINDS))
    part = lambda f: [F.get(kinds, f["kind"]), f["start"].cast("string"), f["stop"].cast("string"), *[F.when(f["live"], "live").otherwise("copied")] * classes]
    return F.array_join(F.transform(spans, lambda f: F.concat_ws(":", *part(f))), ",")


def replaced(text: str, spans: list[tuple[int, int, bool]], live: str, copied: str) -> str:
    """text with its spans (start, end, whether live) replaced; spans that overlap are one, and live if one of them is."""
    parts, end, runs = [], 0, []
    for a, b, is_live in sorted(spans):
        if runs and a < runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], b), runs[-1][2] or is_live)
        else:
            runs.append((a, b, is_live))
    for a, b, is_live in runs:
        parts += [text[end:a], live if is_live else copied]
        end = b
    return "".join([*parts, text[end:]])


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str | None = "source", most_owners: int = MOST_OWNERS, most_repos: int = MOST_REPOS, put: str = "[SECRET]", example: str = "[EXAMPLE]") -> DataFrame:
    """docs with each secret of the text replaced: live ones by put, widely copied ones by example; all rows, all columns, a null text stays null.

    A column n_chars, if there is one, gets the length of the new text.
    """
    names = {k: free_name(docs, f"_secret_{k}") for k in ("key", "mark", "known")}
    found = cut(scanned(docs, id_col, text_col, repo_col).drop("id"))
    known = judged(found, most_owners, most_repos).select(F.col("key").alias(names["key"]), F.col("mark").alias(names["mark"]), F.transform("known", lambda f: F.struct(f["start"], f["stop"], f["live"])).alias(names["known"]))
    keyed = docs.withColumns({names["key"]: key_of(id_col), names["mark"]: F.xxhash64(bytes_of(text_col), F.lit(1))})
    source = keyed.join(known, [names["key"], names["mark"]], "left").select(*[F.col(f"`{c}`") for c in docs.columns], names["known"])
    schema, names = docs.schema, docs.columns
    at = names.index(text_col)

    def run(batches):
        for batch in pieces(batches):
            found, texts = batch.column(batch.num_columns - 1), batch.column(at)
            if found.null_count < len(found):
                texts = texts.to_pylist()
                for i, spans in enumerate(found.to_pylist()):
                    if spans:
                        texts[i] = replaced(texts[i], [(s["start"], s["stop"], s["live"]) for s in spans], put, example)
            columns = {c: batch.column(i) for i, c in enumerate(names)} | {text_col: texts}
            yield batch_of(columns, schema)

    out = source.mapInArrow(run, schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length(F.col(f"`{text_col}`")).cast(docs.schema["n_chars"].dataType)))
    return out
