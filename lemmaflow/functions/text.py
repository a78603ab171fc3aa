"""Scalar functions over clause texts, features and solver logs."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a static token is.
TOKEN = r"[A-Za-z0-9_]+|[()=,~|&!]|:\$i|:\$o"


def _rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+\z", "")


def clean_clause(text: Column) -> Column:
    """Provenance goes: all from the first ``file(`` or else ``inference(``, then one trailing comma."""
    cut = F.when(F.contains(text, F.lit("file(")), F.substring_index(text, "file(", 1)).otherwise(F.substring_index(text, "inference(", 1))
    return _rstrip(F.regexp_replace(_rstrip(cut), r",\z", ""))


def annotated_formula(text: Column) -> Column:
    """The third field of a ``tcf`` wrapper whose first two hold no parentheses; other texts stay as they are."""
    body = F.regexp_extract(text, r"(?s)^\s*tcf\s*\([^,()]*,[^,()]*,(.*)\z", 1)
    return F.when(text.rlike(r"(?s)^\s*tcf\s*\([^,()]*,[^,()]*,"), F.regexp_replace(F.trim(body), r"\.\z", "")).otherwise(text)


def normalize_text(text: Column) -> Column:
    """Words (letters, digits and _ of all scripts) of over 40 characters and capitalised words are masked, operators padded, spaces folded."""
    masked = F.regexp_replace(text, r"[\p{L}\p{N}_]{41,}", "<SYM_LONG>")
    masked = F.regexp_replace(masked, r"(?<![\p{L}\p{N}_])[A-Z][\p{L}\p{N}_]*", "VAR")
    padded = F.regexp_replace(masked, r"([()=,~&|])", " $1 ")
    return F.trim(F.regexp_replace(padded, r"(?U)\s+", " "))


def bucket(value: Column, cuts: tuple[int, int, int]) -> Column:
    """0 to 3 by three upper bounds; null counts as 0."""
    v = F.coalesce(value, F.lit(0))
    return F.when(v <= cuts[0], 0).when(v <= cuts[1], 1).when(v <= cuts[2], 2).otherwise(3)


def feature_prefix(horn: Column, unit: Column, epr: Column, conj_dist: Column, born: Column) -> Column:
    def flag(x: Column) -> Column:
        return F.coalesce(x.cast("int"), F.lit(0)) != 0

    parts = [flag(x).cast("int").cast("string") for x in (horn, unit, epr)]
    parts += [bucket(conj_dist, (0, 2, 5)).cast("string"), bucket(born, (0, 8, 32)).cast("string")]
    return F.concat(*[F.concat(F.lit(f"<{n}"), p, F.lit(">")) for n, p in zip("HUECB", parts, strict=True)], F.lit(" "))


def wrap_query(text: Column) -> Column:
    return F.concat(F.lit("<Q> "), text, F.lit(" </Q>"))


def wrap_document(prefix: Column, text: Column) -> Column:
    return F.concat(prefix, F.lit("<D> "), text, F.lit(" </D>"))


def static_tokens(text: Column, whole: bool = True) -> Column:
    """All tokens; where there is none, the ``whole`` text."""
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    if not whole:
        return found
    return F.when(F.size(found) > 0, found).otherwise(F.array(text))


def truncate(ids: Column, n: int | None) -> Column:
    return F.slice(ids, 1, n) if n else ids


def token_weight(text: Column) -> Column:
    """Variables count one, bars two."""
    return F.regexp_count(text, F.lit(r"\b[A-Z]\w*\b")) + 2 * F.regexp_count(text, F.lit(r"\|"))


def constants(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\bC\d+\b"), F.lit(0)))


def chunks(tokens: Column, length: int = 256, stride: int = 192, most: int = 4) -> Column:
    """Windows of ``length`` at each ``stride``, up to the first short one, ``most`` at most."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0)), F.lit(stride))
    needed = F.filter(starts, lambda s: (s == 0) | (s - stride + length <= F.size(tokens)))
    return F.transform(F.slice(needed, 1, most), lambda s: F.slice(tokens, s + 1, F.lit(length)))


def run_record(text: Column) -> list[Column]:
    """Columns of one solver log."""

    def number(name: str, kind: str = "bigint", pattern: str = r"(-?\d+)") -> Column:
        return F.regexp_extract(text, rf"{name}:\s*{pattern}", 1).try_cast(kind)

    status = F.nullif(F.regexp_extract(text, r"SZS status\s+(\w+)", 1), F.lit(""))
    block = F.regexp_extract(text, r"(?s)SZS output start CNFRefutation(.*?)(?:SZS output end CNFRefutation|\z)", 1)
    steps = F.size(F.filter(F.split(block, "\n"), lambda line: line.rlike(r"(tcf|cnf)\(")))
    mode = F.nullif(F.regexp_extract(text, r"--interactive_mode\s+(true|false)", 1), F.lit(""))
    return [
        status.alias("status"),
        F.coalesce(status.isin("Theorem", "Unsatisfiable", "Satisfiable"), F.lit(False)).alias("solved"),
        (mode == "true").alias("interactive_mode"),
        number("total_time", "double", r"([0-9.]+)").alias("total_time"),
        steps.cast("long").alias("proof_steps"),
        *[number(f"{e}_num_in_passive").alias(f"{e}_passive") for e in ("inst", "sup", "res")],
        *[number(f"{e}_num_of_loops").alias(f"{e}_loops") for e in ("inst", "sup", "res")],
    ]
