"""Secret scans with corpus-wide ownership frequency, with built-in functions only.

Candidates are the base kinds (assign, access, hex) and two wider ones (issued: tokens with an issuer's
prefix; opaque: long mixed strings). Each candidate's value is hashed and counted over the corpus by distinct owners
and by distinct repositories, where rows of equal text are one repository and its forks. A value that at least
OWNERS owners and at least REPOSITORIES repositories have is a widely copied example; any other value is live, in
however many copies it is, and also where a few owners share it. Base spans are always reported; wider ones only if
they are live.

Defined cases: a null text is empty; null owners count as one value of their own; repeated rows give a row each;
spans are in code points, end exclusive; other columns are
ignored by the scan and kept by the redaction, whatever their names; an empty table gives no rows. Texts of very
many spans take time by n^1.5, as sums over them are made in stretches.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmaflow.llm.common import materialize, text_of, unused

#: The patterns of each kind, in the order of ties.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ISSUED = r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})"
OPAQUE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{32,}"
KINDS = ["assign", "access", "hex", "issued", "opaque"]
BASE = KINDS[:3]
PATTERNS = dict(zip(KINDS, [ASSIGN, ACCESS, HEX, ISSUED, OPAQUE], strict=True))
#: Before the long patterns run, a text must hold one of these.
GUARD = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]",
    "access": "AKIA",
    "hex": HEX,
    "issued": "gh[pousr]_|xox[abprs]-|k_live_|AIza",
    "opaque": r"[A-Za-z0-9+/_-]{32}",
}
#: A value of so many owners and so many repositories is an example.
OWNERS = 4
REPOSITORIES = 4
#: A set of this many flags at most is broadcast to tell which texts are to be changed.
FLAGS = 1 << 20
SPAN = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def _blocks(values: Column) -> Column:
    """An array in stretches of about the square root of its size, so that folds that append stay cheap."""

    def cut(held: Column) -> Column:
        n = F.size(held)
        step = F.greatest(F.lit(1), F.ceil(F.sqrt(n))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), step), lambda k: F.slice(held, k + 1, step))

    return _let(values, cut)


def _before(values: Column, merge) -> Column:
    """For each element of an array of ints, what ``merge`` makes of 0 and all elements before it."""

    def scan(part: Column) -> Column:
        start = F.array(F.lit(0)).cast("array<int>")
        return F.aggregate(part, start, lambda seen, x: F.concat(seen, F.array(merge(F.element_at(seen, -1), x))).cast("array<int>"))

    def placed(inner: Column) -> Column:
        base = F.slice(scan(F.transform(inner, lambda g: F.element_at(g, -1))), F.lit(1), F.size(inner))
        return F.flatten(F.zip_with(inner, base, lambda g, b: F.transform(F.slice(g, F.lit(1), F.size(g) - 1), lambda x: merge(b, x))))

    return _let(F.transform(_blocks(values), scan), placed)


def _spans(text: Column, kind: str) -> Column:
    """All leftmost matches of a kind: what lies between them gives the places."""
    pattern = PATTERNS[kind]

    def found(hits: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), lambda g: F.length(g))
        return _let(gaps, lambda gaps: F.zip_with(hits, _starts(hits, gaps), span))

    def _starts(hits: Column, gaps: Column) -> Column:
        both = F.zip_with(hits, gaps, lambda h, g: F.length(h) + g)
        return F.zip_with(_before(both, lambda a, b: a + b), gaps, lambda a, b: a + b)

    def span(hit: Column, start: Column) -> Column:
        value = F.regexp_extract(hit, f"^{pattern}", 1) if kind == "assign" else hit
        return F.struct(
            start.alias("start"),
            F.lit(KINDS.index(kind)).alias("rank"),
            F.lit(kind).alias("kind"),
            (start + F.length(hit)).alias("end"),
            value.alias("value"),
        )

    spans = _let(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), found).cast(SPAN)
    if kind == "assign":
        spans = F.filter(spans, lambda s: F.length(s["value"]) >= 6)
    return F.when(text.rlike(GUARD[kind]), spans).otherwise(F.array().cast(SPAN))


def candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and spans: array of (start, rank, kind, end, value) in order."""
    read = docs.select(*keep, text_of().alias("text"))
    return read.select(*keep, F.array_sort(F.concat(*[_spans(F.col("text"), k) for k in KINDS])).alias("spans"))


def ownership(spans: DataFrame, owner: str, repository: str) -> DataFrame:
    """value_hash, n_owners, n_repositories. Distinct pairs first, so that a copied value is summed before it moves."""

    def counted(of: str, name: str) -> DataFrame:
        pairs = spans.groupBy("value_hash", of).agg(F.lit(1).alias("one"))
        return pairs.groupBy("value_hash").agg(F.count(F.lit(1)).alias(name))

    return counted(owner, "n_owners").join(counted(repository, "n_repositories"), "value_hash")


def _judged(one: DataFrame, owner: str, repository: str) -> DataFrame:
    """``one`` (a candidate a row, as s) with verdict, without wider candidates that aren't live."""
    one = one.withColumn("value_hash", F.sha2("s.value", 256))
    live = (F.col("n_owners") < OWNERS) | (F.col("n_repositories") < REPOSITORIES)
    judged = one.join(ownership(one, owner, repository), "value_hash").withColumn("verdict", F.when(live, "live").otherwise("example"))
    return judged.where(F.col("s.kind").isin(BASE) | live)


def _gathered():
    return F.array_sort(F.collect_set(F.struct("s.start", "s.rank", "s.kind", "s.end", "verdict"))).alias("spans")


def scan_secrets(docs: DataFrame, repo: str = "doc_id", owner: str = "source") -> DataFrame:
    """The rows of ``docs`` as repo, owner, row_key, spans: array of (start, rank, kind, end, verdict)."""
    own = docs.select(F.col(repo).alias("_repo"), F.col(owner).alias("_owner"), F.xxhash64("text").alias("_repository"), "text")
    found = materialize(candidates(own, ["_repo", "_owner", "_repository"]).withColumn("row_key", F.monotonically_increasing_id()))
    one = found.select("_owner", "_repository", "row_key", F.explode("spans").alias("s"))
    judged = _judged(one, "_owner", "_repository").groupBy("row_key").agg(_gathered())
    empty = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,verdict:string>>")
    return (
        found.select("_repo", "_owner", "row_key")
        .join(judged, "row_key", "left")
        .select(F.col("_repo").alias(repo), F.col("_owner").alias(owner), "row_key", F.coalesce("spans", empty).alias("spans"))
    )


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mark: str = "<secret>") -> Column:
    """``text`` with its live spans replaced; overlapping spans become one."""

    def written_blocks(live: Column) -> Column:
        ends = _before(F.transform(live, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        rows = F.zip_with(live, ends, lambda s, e: F.struct(s["start"].alias("start"), s["end"].alias("end"), e.alias("seen")))
        # A stretch of spans is cut out of the text once, and the spans out of it.
        parts = F.transform(_blocks(rows), lambda g: _let(F.substr(text, g[0]["seen"] + 1, F.element_at(g, -1)["end"] - g[0]["seen"]), lambda own: F.array_join(F.transform(g, lambda s: piece(own, s, g[0]["seen"])), "")))
        rest = F.greatest(F.array_max(F.transform(live, lambda s: s["end"])), F.lit(0))
        return F.concat(F.array_join(parts, ""), F.substr(text, rest + 1, F.length(text)))

    def piece(own: Column, s: Column, at: Column) -> Column:
        between = F.substr(own, s["seen"] - at + 1, s["start"] - s["seen"])
        return F.when(s["start"] >= s["seen"], F.concat(between, F.lit(mark))).otherwise("")

    return _let(F.filter(spans, lambda s: s["verdict"] == "live"), lambda live: F.when(F.size(live) == 0, text).otherwise(written_blocks(live)))


def redact_secrets(docs: DataFrame, repo: str = "doc_id", owner: str = "source") -> DataFrame:
    """``docs`` with the live spans of text replaced; only texts that have one move."""
    own, flag = unused("text_key", docs), unused("flag", docs)
    key = F.xxhash64(repo, "text")
    read = docs.select(F.col(owner).alias("owner"), F.xxhash64("text").alias("repository"), key.alias("text_key"), "text")
    found = materialize(candidates(read, ["owner", "repository", "text_key"]).where(F.size("spans") > 0))
    one = found.select("owner", "repository", "text_key", F.explode("spans").alias("s"))
    spans = _judged(one, "owner", "repository").where("verdict = 'live'").groupBy(F.col("text_key").alias(own)).agg(_gathered().alias(unused("spans", docs)))
    found_spans = unused("spans", docs)
    marked = F.pmod(own, F.lit(FLAGS)).cast("int").alias(flag)
    spans = materialize(spans)
    flags = F.broadcast(spans.select(marked).distinct())  # FLAGS rows at most
    keyed = docs.withColumn(own, key)
    keyed = keyed.select("*", marked)
    moved = keyed.join(flags, flag, "left_semi").join(spans, own, "left")
    moved = moved.withColumn("text", F.when(F.col(found_spans).isNull(), F.col("text")).otherwise(redact(F.col("text"), F.col(found_spans))))
    return moved.select(docs.columns).union(keyed.join(flags, flag, "left_anti").select(docs.columns))
