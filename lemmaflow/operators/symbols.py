"""Kinds, numbers and uses of symbols over batches of formulas, from node and token tables.

A batch is numbered in two phases: symbols of the clauses in scope are seeded in scope order, then those of the
batch are used in its order. A symbol that is a function and a predicate in the scope is seeded as a predicate, and
used as a function where = or != follows its call; that may add a number.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmaflow.functions import formula as trees
from lemmaflow.session import written_once

SYMBOL = ["batch", "name", "arity"]


def occurrences(nodes: DataFrame) -> DataFrame:
    """batch, name, arity, is_function, is_predicate: where symbols stand in the trees of a batch's clauses."""
    leaf = (F.col("kind") == "leaf") & F.col("in_term") & (F.col("symbol") != "") & ~F.substring("symbol", 1, 1).rlike(r"^\p{Lu}")
    found = nodes.where((F.col("kind") == "atom") | leaf)
    return found.groupBy("batch", F.col("symbol").alias("name"), "arity").agg(F.bool_or("in_term").alias("is_function"), F.bool_or(~F.col("in_term")).alias("is_predicate"))


def kind_conflicts(kinds: DataFrame) -> DataFrame:
    """batch, conflicts: name/arity of the symbols that are both."""
    both = kinds.where("is_function and is_predicate and arity > 0")
    return both.groupBy("batch").agg(F.array_sort(F.collect_set(F.concat_ws("/", "name", "arity"))).alias("conflicts"))


def symbol_places(scope: DataFrame, used: DataFrame) -> DataFrame:
    """batch, name, arity, is_function, is_predicate (in the scope), and the first place of each form and phase: seeded_constant to used_equated.

    A place is the order of the clause and then the token, as one number, so that it is counted in hash tables. A formula
    that repeats in a batch is read once.
    """
    none = F.lit(None).cast("long")
    rows = lambda df, **phases: df.select("batch", F.coalesce("formula", F.lit("")).alias("formula"), *[c.alias(n) for n, c in phases.items()])
    order = F.col("ord").cast("long")
    both = rows(scope, seeded=order, used=none).union(rows(used, seeded=none, used=order))
    formulas = both.groupBy("batch", "formula").agg(F.min("seeded").alias("seeded"), F.min("used").alias("used"))
    each = formulas.select("batch", "seeded", "used", F.inline(trees.formula_uses(F.col("formula"))))
    place = lambda phase, tok: (F.col(phase).cast("decimal(38,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col(tok)).cast("decimal(38,0)")
    seen = lambda where: F.coalesce(F.bool_or(F.col(where) & F.col("seeded").isNotNull()), F.lit(False))
    firsts = [F.min(place(phase, form)).alias(f"{phase}_{form}") for phase in ("seeded", "used") for form in trees.FORMS]
    return each.groupBy(*SYMBOL).agg(seen("in_term").alias("is_function"), seen("outside").alias("is_predicate"), *firsts)


def numbered(places: DataFrame) -> DataFrame:
    """A row for each kind of a symbol: the columns of SYMBOL, is_function, is_predicate, kind, canon, is_used, and the forms it is used in.

    ``places``: of ``symbol_places``. Names that are only called in trees, and no tokens, have one row without kind.
    """
    both = F.col("is_function") & F.col("is_predicate")
    seed = F.when(F.col("is_function") & ~F.col("is_predicate"), "function").otherwise("predicate")
    none = F.lit(None).cast("decimal(38,0)")
    entry = lambda kind, seeded, used, forms: F.struct(kind.alias("kind"), seeded.alias("seeded"), used.alias("used"), forms.alias("forms"))
    called, equated = F.array(F.lit(1)), F.array(F.lit(2))
    entries = F.array(
        entry(F.lit("constant"), F.col("seeded_constant"), F.col("used_constant"), F.array(F.lit(0))),
        entry(seed, F.least("seeded_called", "seeded_equated"), F.when(both, F.col("used_called")).otherwise(F.least("used_called", "used_equated")), F.when(both, called).otherwise(F.concat(called, equated))),
        entry(F.lit("function"), none, F.when(both, F.col("used_equated")), equated),
    )
    told = F.filter(entries, lambda e: e["seeded"].isNotNull() | e["used"].isNotNull())
    kinds = places.select(*SYMBOL, "is_function", "is_predicate", F.explode_outer(told).alias("e")).select(*SYMBOL, "is_function", "is_predicate", "e.*")
    # All seeds come before what is first used later.
    rank = F.row_number().over(Window.partitionBy("batch", "kind").orderBy(F.asc_nulls_last("seeded"), "used", "name", "arity"))
    canon = F.concat(F.upper(F.substring("kind", 1, 1)), rank.cast("string"))
    return kinds.select(*SYMBOL, "is_function", "is_predicate", "kind", canon.alias("canon"), F.col("used").isNotNull().alias("is_used"), "forms")


def symbol_key() -> Column:
    return F.when(F.col("kind") == "constant", F.col("canon")).otherwise(F.concat_ws("/", "canon", "arity"))


def canonical_batch(scope: DataFrame, used: DataFrame, keep: tuple = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Canonical clauses, the symbols, and conflicts of each batch. scope, used: batch, key, ord, formula.

    Clauses: batch, key, ord, ``keep`` (of used), canonical, variables (map name to V<n>), symbols (map of symbol key to
    its names), lit_count.
    """
    told = written_once(numbered(symbol_places(scope, used)))  # read by several branches; a row for each symbol of a batch
    numbers = told.where("kind is not null").select(*SYMBOL, "kind", "canon", "is_used")
    own = told.where("is_used").select(*SYMBOL, F.explode("forms").alias("form"), "canon", symbol_key().alias("symbol"))
    head = ["batch", "key", "ord", *keep, "formula"]
    rows = used.withColumn("formula", F.coalesce("formula", F.lit(""))).select(*head, F.posexplode_outer(trees.formula_symbols(F.col("formula"))).alias("at", "s"))
    met = rows.select(*head, "at", "s.*").join(own.hint("merge"), [*SYMBOL, "form"], "left")  # in files symbols look small enough to be sent whole
    per = met.groupBy(*head).agg(F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "canon", "name", "symbol")))).alias("parts"))
    per = per.withColumn("made", trees.canonical_form(F.col("formula"), F.transform("parts", lambda p: p["canon"])))
    symbol_names = F.array_distinct(F.transform(F.filter("parts", lambda p: p["symbol"].isNotNull()), lambda p: F.struct(p["symbol"].alias("s"), p["name"].alias("n"))))
    clauses = per.select(
        *head[:-1],
        F.col("made.canonical").alias("canonical"),
        F.map_from_arrays("made.names", F.transform("made.names", lambda _, i: F.concat(F.lit("V"), i.cast("string")))).alias("variables"),
        F.map_from_entries(F.transform(symbol_names, lambda x: F.struct(x["s"], F.array(x["n"])))).alias("symbols"),
        F.col("made.lit_count").alias("lit_count"),
    )
    return clauses, numbers, kind_conflicts(told)


def _original() -> Column:
    return F.array(F.when(F.col("kind") == "constant", F.col("name")).otherwise(F.concat_ws("/", "name", "arity")))


def symbol_map(numbers: DataFrame) -> DataFrame:
    """batch, symbol, original, kind, arity of the symbols that the batch uses."""
    return numbers.where("is_used").select("batch", symbol_key().alias("symbol"), _original().alias("original"), "kind", "arity")


def _counters() -> list[Column]:
    return [F.count(F.lit(1)).alias("symbols_total_parsed"), F.count_if("is_used").alias("symbol_map_size_used")]


def batch_counters(numbers: DataFrame) -> DataFrame:
    return numbers.groupBy("batch").agg(*_counters())


def conjecture_targets(conjectures: DataFrame) -> DataFrame:
    """batch, functors (name/arity), first_arg_consts, goal_consts, sorted. conjectures: batch, canonical.

    Only where the whole formula is an equation or inequation; others have empty targets.
    """
    read = conjectures.select("batch", trees.canonical_nodes(F.col("canonical")).alias("nodes"))
    root = F.exists("nodes", lambda x: (x["node"] == 0) & (x["kind"] == "op") & x["symbol"].isin("=", "neq"))
    sides = F.when(root, F.filter("nodes", lambda x: (x["parent"] == 0) & (x["kind"] == "atom"))).otherwise(F.filter("nodes", lambda _: F.lit(False)))
    read = read.withColumn("sides", sides).withColumn("under", F.transform("sides", lambda x: x["node"]))
    consts = F.filter("nodes", lambda x: (x["kind"] == "leaf") & x["symbol"].rlike(r"^C\d+$") & F.array_contains("under", x["parent"]))
    read = read.withColumn("consts", consts)
    listed = lambda rows, of: F.array_sort(F.array_distinct(F.transform(rows, of)))
    return read.select(
        "batch",
        listed("sides", lambda x: F.concat_ws("/", x["symbol"], x["arity"])).alias("functors"),
        listed(F.filter("consts", lambda x: x["pos"] == 0), lambda x: x["symbol"]).alias("first_arg_consts"),
        listed("consts", lambda x: x["symbol"]).alias("goal_consts"),
    )


def _met(clauses: DataFrame, targets: DataFrame, how: str) -> DataFrame:
    """``clauses`` with the targets of their batch, and touches, equation, first_arg, shared, n_shared, tags."""
    names = F.transform("functors", lambda f: F.substring_index(f, "/", 1))
    # Clauses are short, but dear to read: they are dealt to all tasks, however few bytes they have.
    tasks = int(clauses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read = clauses.repartition(tasks, "batch").join(targets, "batch", how).withColumn("names", names).withColumn("nodes", trees.canonical_nodes(F.col("canonical")))
    atoms = F.filter("nodes", lambda x: (x["kind"] == "atom") & F.array_contains("names", x["symbol"]))
    led = F.filter("nodes", lambda x: (x["kind"] == "leaf") & (x["pos"] == 0) & x["parent"].isNotNull() & F.array_contains("first_arg_consts", x["symbol"]))
    goals = F.transform(F.filter("atoms", lambda x: ~x["negated"]), lambda x: x["node"])
    root = F.exists("nodes", lambda x: (x["node"] == 0) & (x["kind"] == "op") & x["symbol"].isin("=", "neq"))
    shared = F.array_sort(F.array_distinct(F.array_intersect(F.regexp_extract_all("canonical", F.lit(r"\bC\d+\b"), F.lit(0)), F.col("goal_consts"))))
    met = read.withColumn("atoms", atoms).withColumns(
        {
            "touches": F.exists("names", lambda n: F.contains("canonical", F.concat(n, F.lit("(")))),
            "equation": root & (F.size(F.filter("atoms", lambda x: x["parent"] == 0)) == 2),
            "first_arg": F.arrays_overlap(goals, F.transform(led, lambda x: x["parent"])),
            "shared": shared,
        }
    )
    tags = F.array_compact(
        F.array(
            F.when(F.col("touches"), "touches_target_functor"),
            F.when(F.col("equation"), "eq_of_target_functor"),
            F.when(F.col("first_arg"), "first_arg_in_goal"),
            F.when(F.size("shared") > 0, F.concat(F.lit("shares_goal_consts:"), F.size("shared"))),
        )
    )
    return met.withColumns({"n_shared": F.size("shared").cast("long"), "tags": tags})


def tree_tags(clauses: DataFrame, targets: DataFrame) -> DataFrame:
    """batch, key, touches, equation, first_arg, n_shared, shared, tags. clauses: batch, key, canonical.

    An atom under a negation is no sign of a first argument.
    """
    return _met(clauses.select("batch", "key", "canonical"), targets, "inner").select("batch", "key", "touches", "equation", "first_arg", "shared", "n_shared", "tags")


#: What a document tells of the tags of a clause.
TAG_INFO = ["touches", "equation", "first_arg", "n_shared", "shared"]


def tagged_clauses(clauses: DataFrame, targets: DataFrame) -> DataFrame:
    """``clauses`` (of ``canonical_batch``, with role) with tags and tag_info: null for conjectures and where a batch has no targets."""
    has = (F.col("role") != "conjecture") & F.col("functors").isNotNull()
    told = {"tag_info": F.when(has, F.struct(*TAG_INFO)), "tags": F.when(has, F.col("tags"))}
    return _met(clauses, targets, "left").select(*clauses.columns, *[c.alias(n) for n, c in told.items()])


def batch_documents(clauses: DataFrame, numbers: DataFrame, conflicts: DataFrame, targets: DataFrame, tags: DataFrame | None = None, scope: str = "batch") -> DataFrame:
    """batch, metadata, symbol_map, conjecture, conjecture_targets, context_clauses, candidate_clauses: a nested row per batch.

    clauses: of ``canonical_batch``, with role, and with tags and tag_info where no ``tags`` are given; the JSON of a
    document is ``to_json`` of its columns. A batch is bounded by its limits of context and candidates, so a document is small.
    """
    told = clauses if tags is None else clauses.join(tags.select("batch", "key", "tags", F.struct(*TAG_INFO).alias("tag_info")), ["batch", "key"], "left")
    record = F.struct("ord", F.col("key").alias("id"), F.col("canonical").alias("canonical_formula"), "lit_count", F.col("variables").alias("variable_mapping"), F.col("symbols").alias("local_symbols"), "tags", "tag_info")
    of = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, record)), lambda a, b: (a["ord"] - b["ord"]).cast("int")), lambda r: r.dropFields("ord"))
    per = told.groupBy("batch").agg(F.get(of("conjecture"), 0).alias("conjecture"), of("context").alias("context_clauses"), of("candidate").alias("candidate_clauses"))
    entry = F.when(F.col("is_used"), F.struct(symbol_key().alias("symbol"), F.struct(_original().alias("original"), "kind", "arity")))
    mapped = F.when(F.count_if("is_used") > 0, F.map_from_entries(F.array_sort(F.collect_list(entry))))
    symbols = numbers.groupBy("batch").agg(mapped.alias("symbol_map"), *_counters())
    counted = per.join(symbols, "batch", "left").join(conflicts, "batch", "left").join(targets, "batch", "left")
    metadata = F.struct(
        F.lit("1.0").alias("schema_version"),
        F.lit(scope).alias("mapping_scope"),
        F.col("batch").cast("string").alias("batch_id"),
        F.coalesce("conflicts", F.array().cast("array<string>")).alias("kind_conflicts"),
        "symbols_total_parsed",
        "symbol_map_size_used",
    )
    found = F.struct("functors", "first_arg_consts", "goal_consts").alias("conjecture_targets")
    return counted.select("batch", metadata.alias("metadata"), "symbol_map", "conjecture", found, "context_clauses", "candidate_clauses")


def readable(documents: DataFrame) -> DataFrame:
    """batch, text: symbols in order, the conjecture, and the first five clauses of each list."""
    symbol = lambda e: F.concat(F.lit("  "), e["key"], F.lit(" (kind="), e["value"]["kind"], F.lit(", arity="), e["value"]["arity"], F.lit("): "), F.array_join(e["value"]["original"], ", "))
    clause = lambda c: F.concat(F.lit("  ID "), c["id"], F.lit(": "), c["canonical_formula"])
    lines = F.concat(
        F.array(F.lit("Symbol mapping:")),
        F.transform(F.array_sort(F.map_entries("symbol_map")), symbol),
        F.when(F.col("conjecture").isNotNull(), F.array(F.lit("\nConjecture:"), clause(F.col("conjecture")))).otherwise(F.array().cast("array<string>")),
        *[x for title, c in (("Context", "context_clauses"), ("Candidate", "candidate_clauses")) for x in (F.array(F.lit(f"\n{title} clauses:")), F.transform(F.slice(c, 1, 5), clause))],
    )
    return documents.select("batch", F.array_join(lines, "\n").alias("text"))
