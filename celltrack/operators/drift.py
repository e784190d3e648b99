"""Records whose schema drifts between files: one typed table and a report of each change.

Each JSON record is loaded as a map from path to value with the value's raw type (a
VARIANT, so nothing is guessed or cast on reading). Names are brought to their quantity by ``ALIASES``
after normalising case, separators and word order. Path and type statistics are aggregated by file,
files of one producer are compared in time order, and typed columns are projected with
every failed cast listed. Statistics are one row for each file and field before any window, so a
producer holding a third of all records costs no more than its number of files.
"""

from __future__ import annotations

import re
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The names under which each quantity appears, and the methods behind numeric codes.
ALIASES = {
    "u_opt": ["u_opt", "u_optical", "u_optflow"],
    "u_spl": ["u_spl", "u_split"],
    "method": ["method", "vec_method", "best_method", "mtd"],
    "far": ["far", "fa_ratio", "far_ratio", "false_alarm_ratio"],
}
LEVELS = 4
METHOD_CODES = ["noc", "spl", "mrg", "inc", "opt", "elp"]


def name_key(name: str) -> str:
    """Lower-case words of a name in alphabetical order: uOpt, U-OPT and opt_u are one."""
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    return "_".join(sorted(w for w in re.split(r"[^a-z0-9]+", spaced.lower()) if w))


def _name_key(name: Column) -> Column:
    spaced = F.lower(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2"))
    return F.array_join(F.array_sort(F.filter(F.split(spaced, r"[^a-z0-9]+"), lambda w: w != "")), "_")


def known_names(aliases: dict[str, list[str]] = ALIASES) -> dict[str, str]:
    """Every name key a quantity goes by: its aliases, and two or more words of one alias that no other quantity shares."""
    known = {name_key(a): q for q, names in aliases.items() for a in names}
    parts: dict[str, set[str]] = {}
    for q, names in aliases.items():
        for a in names:
            words = name_key(a).split("_")
            for n in range(2, len(words)):
                for some in combinations(words, n):
                    parts.setdefault("_".join(some), set()).add(q)
    return {k: min(q) for k, q in parts.items() if len(q) == 1} | known


def quantity(name: Column, aliases: dict[str, list[str]] = ALIASES) -> Column:
    """The quantity a field name stands for, null for other fields."""
    return F.create_map(*(F.lit(x) for pair in known_names(aliases).items() for x in pair))[_name_key(name)]


def raw_type(value: Column) -> Column:
    """number, string, boolean, array or object; null for JSON null."""
    t = F.schema_of_variant(value)
    return (
        F.when(t == "VOID", F.lit(None).cast("string"))
        .when(t == "STRING", "string")
        .when(t == "BOOLEAN", "boolean")
        .when(t.startswith("ARRAY"), "array")
        .when(t.startswith("OBJECT"), "object")
        .otherwise("number")
    )


def path_values(records: DataFrame, payload: str = "payload", keep: tuple[str, ...] = ("producer", "file", "file_ts", "rec_no")) -> DataFrame:
    """``keep`` plus ``(path, value, type)``: one row for each top-level path of each readable record."""
    spark = records.sparkSession
    parsed = records.select(*keep, F.try_parse_json(F.col(payload)).alias("__v")).filter(F.col("__v").isNotNull())
    open_ = parsed.lateralJoin(spark.tvf.variant_explode(F.col("__v").outer()))
    return open_.select(*keep, F.col("key").alias("path"), "value", raw_type(F.col("value")).alias("type"))


def file_statistics(records: DataFrame, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """``(producer, file, file_ts, field, names, types, present)`` for every file and quantity.

    A file whose records are all unreadable is there with nothing present.
    """
    seen = (
        path_values(records, keep=("producer", "file", "file_ts"))
        .withColumn("field", quantity(F.col("path"), aliases))
        .filter("field IS NOT NULL")
        .groupBy("producer", "file", "file_ts", "field")
        .agg(F.array_sort(F.collect_set("path")).alias("names"), F.array_sort(F.collect_set("type")).alias("types"))
    )
    files = records.select("producer", "file", "file_ts").distinct()
    every = files.withColumn("field", F.explode(F.array(*(F.lit(q) for q in aliases))))
    on = [every[c].eqNullSafe(seen[c]) for c in ("producer", "file", "file_ts")] + [every["field"] == seen["field"]]
    return every.join(seen, on, "left").select(
        every["producer"], every["file"], every["file_ts"], every["field"],
        F.coalesce(seen["names"], F.array().cast("array<string>")).alias("names"),
        F.coalesce(seen["types"], F.array().cast("array<string>")).alias("types"),
        seen["names"].isNotNull().alias("present"),
    )


def schema_changes(records: DataFrame, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """``(file, field, change)``: each file against the one before it of its producer.

    Order is file_ts, then file name; records without producer are one producer. Change is added, removed,
    renamed or retyped; a file in which the field is only ever null has no type to compare.
    """
    w = Window.partitionBy("producer", "field").orderBy(F.col("file_ts"), F.col("file"))
    s = file_statistics(records, aliases)
    s = s.withColumns({f"p_{c}": F.lag(c).over(w) for c in ("names", "types", "present")})
    both = F.col("present") & F.col("p_present")
    changes = F.array(
        F.when(F.col("present") & ~F.col("p_present"), "added"),
        F.when(~F.col("present") & F.col("p_present"), "removed"),
        F.when(both & (F.col("names") != F.col("p_names")), "renamed"),
        F.when(both & (F.size("types") > 0) & (F.size("p_types") > 0) & (F.col("types") != F.col("p_types")), "retyped"),
    )
    return s.select("file", "field", F.explode(F.array_compact(changes)).alias("change"))


def nested_values(records: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``(producer, file, file_ts, path, type, number)``: a row for every path of each readable record, objects opened ``levels`` deep.

    Paths join the keys by dots; an object is listed itself and by its members, an array as a whole. ``number`` is the
    value where it is one.
    """
    keys = ("producer", "file", "file_ts")
    at = path_values(records, keep=keys)
    out = at
    for _ in range(levels - 1):
        at = _opened(at, keys)
        out = out.unionByName(at)
    return out.filter("path IS NOT NULL").select(*keys, "path", "type", F.when(F.col("type") == "number", F.try_variant_get("value", "$", "double")).alias("number"))


def _opened(at: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The members of the objects among ``at``."""
    up = at.filter("type = 'object'").select(*keys, F.col("path").alias("__up"), F.col("value").alias("__object"))
    members = up.lateralJoin(at.sparkSession.tvf.variant_explode(F.col("__object").outer()))
    return members.select(*keys, F.concat("__up", F.lit("."), "key").alias("path"), "value", raw_type(F.col("value")).alias("type"))


def path_changes(records: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``(file, path, change, was)``: every path of each file against the file before it of its producer.

    Changes are added, removed and retyped, of fields under their own names; ``was`` is the earlier types of a retyped
    path, joined by '+'. Unlike ``schema_changes`` no name is looked up.
    """
    w = Window.partitionBy("producer", "path").orderBy("n")
    seen = nested_values(records, levels).groupBy("producer", "file", "file_ts", "path").agg(F.array_join(F.array_sort(F.collect_set("type")), "+").alias("types"))
    order = Window.partitionBy("producer").orderBy("file_ts", "file")
    files = records.select("producer", "file", "file_ts").distinct().withColumn("n", F.row_number().over(order))
    named = files.select(*(F.col(c).alias(f"__{c}") for c in files.columns))
    at = seen.join(named, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ("producer", "file", "file_ts")]).select("producer", F.col("__n").alias("n"), "file", "path", "types")
    run = at.withColumns({"p_n": F.lag("n").over(w), "p_types": F.lag("types").over(w), "n_n": F.lead("n").over(w)})
    added = run.filter((F.col("n") > 1) & (F.col("p_n").isNull() | (F.col("p_n") < F.col("n") - 1))).select("file", "path", F.lit("added").alias("change"), F.lit(None).cast("string").alias("was"))
    retyped = run.filter((F.col("p_n") == F.col("n") - 1) & (F.col("types") != "") & (F.col("p_types") != "") & (F.col("types") != F.col("p_types"))).select("file", "path", F.lit("retyped").alias("change"), F.col("p_types").alias("was"))
    ended = run.filter(F.col("n_n").isNull() | (F.col("n_n") > F.col("n") + 1))
    removed = ended.join(named, F.col("producer").eqNullSafe(F.col("__producer")) & (F.col("n") + 1 == F.col("__n"))).select(F.col("__file").alias("file"), "path", F.lit("removed").alias("change"), F.lit(None).cast("string").alias("was"))
    return added.unionByName(retyped).unionByName(removed)


def rename_proposals(records: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``(file, path, was, shared, distance)``: for each path added to a file, the removed path that it most likely was.

    Candidates vanish where the path appears and share a word of their names or, both being numbers, their range of
    values; the most shared words, then the least distance of means in spreads, decide. For review, or to extend ``ALIASES``.
    """
    stats = nested_values(records, levels).groupBy("producer", "file", "path").agg(F.avg("number").alias("mean"), F.coalesce(F.stddev_pop("number"), F.lit(0.0)).alias("sd"))
    changes = path_changes(records, levels)
    names = records.select("producer", "file", "file_ts").distinct()
    order = Window.partitionBy("producer").orderBy("file_ts", "file")
    back = names.select("file", F.lag("file").over(order).alias("before"))
    new = changes.filter("change = 'added'").select("file", "path").join(back, "file").join(stats.select("file", "path", F.col("mean").alias("m1"), F.col("sd").alias("s1")), ["file", "path"])
    old = changes.filter("change = 'removed'").select("file", F.col("path").alias("was")).join(back, "file")
    old = old.join(stats.select(F.col("file").alias("before"), F.col("path").alias("was"), F.col("mean").alias("m0"), F.col("sd").alias("s0")), ["before", "was"])
    words = lambda c: F.split(_name_key(F.element_at(F.split(c, r"\."), -1)), "_")
    pair = new.drop("before").join(old.drop("before"), "file").withColumn("shared", F.size(F.array_intersect(words(F.col("path")), words(F.col("was")))))
    pair = pair.withColumn("distance", F.abs(F.col("m1") - F.col("m0")) / F.greatest(F.col("s0") + F.col("s1"), F.lit(1e-9)))
    likely = pair.filter((F.col("shared") > 0) | (F.coalesce(F.col("distance"), F.lit(9.0)) < 1))
    best = F.min_by(F.struct("was", "shared", "distance"), F.struct(-F.col("shared"), F.coalesce("distance", F.lit(1e300)), F.col("was")))
    return likely.groupBy("file", "path").agg(best.alias("b")).select("file", "path", "b.was", "b.shared", "b.distance")


def _text(value: Column, type_: Column) -> Column:
    """The scalar inside a raw value as text: the only element of an array, 'value' of an object; a longer array as a whole."""
    inner = (
        F.when((type_ == "array") & F.try_variant_get(value, "$[1]", "variant").isNull(), F.try_variant_get(value, "$[0]", "string"))
        .when(type_ == "array", F.to_json(value))
        .when(type_ == "object", F.try_variant_get(value, "$.value", "string"))
        .otherwise(F.try_variant_get(value, "$", "string"))
    )
    return F.trim(inner)


def _number(text: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(text, "%", ""), ",", ".")
    number = F.trim(plain).try_cast("double")
    return F.when(text.endswith("%"), number / 100).otherwise(number)


def _method(text: Column) -> Column:
    code = text.try_cast("int")
    named = F.get(F.array(*(F.lit(m) for m in METHOD_CODES)), code)
    low = F.lower(text)
    return F.when(code.isNotNull(), named).otherwise(F.when(low.isin(METHOD_CODES), low))


def unified(records: DataFrame, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """``(producer, file, file_ts, rec_no, u_opt, u_spl, method, far, failed)``.

    One row for each stored record, repeats included; ``failed`` lists ``field=text`` for values that could
    not be cast (null if none). An unreadable payload gives nulls and ``failed = [payload]``. Numbers may
    come as text with decimal comma or per cent, in one-element arrays or with a unit; arrays of several elements fail. Where a record
    carries a quantity under several names, the alphabetically first name counts.
    """
    base = records.select("producer", "file", "file_ts", "rec_no", F.try_parse_json("payload").alias("v"), F.xxhash64("payload").alias("h"))
    key = ["producer", "file", "file_ts", "rec_no", "h"]
    marked = base.withColumn("bad", F.col("v").isNull())
    spark = records.sparkSession
    open_ = marked.lateralJoin(spark.tvf.variant_explode_outer(F.col("v").outer()))
    flat = open_.withColumn("field", quantity(F.col("key"), aliases)).withColumn("type", raw_type(F.col("value"))).withColumn("text", _text(F.col("value"), F.col("type")))
    cast = {f: (_method if f == "method" else _number) for f in aliases}
    one = lambda f, c: F.min_by(c, F.when(F.col("field") == f, F.col("key")))
    wide = flat.groupBy(*key, "bad").agg(
        F.coalesce(F.max(F.when(F.col("pos") == 0, 1)), F.lit(0)).alias("__any"),
        F.greatest(F.lit(1), F.count(F.when(F.coalesce(F.col("pos"), F.lit(0)) == 0, 1))).alias("repeats"),
        *(one(f, F.col("text")).alias(f"t_{f}") for f in aliases),
    )
    failures = F.array_compact(
        F.array(
            F.when(F.col("bad"), F.lit("payload")),
            *(F.when(F.col(f"t_{f}").isNotNull() & cast[f](F.col(f"t_{f}")).isNull(), F.concat(F.lit(f"{f}="), F.col(f"t_{f}"))) for f in aliases),
        )
    )
    return wide.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))).select(
        "producer", "file", "file_ts", "rec_no", *(cast[f](F.col(f"t_{f}")).alias(f) for f in aliases), F.when(F.size(failures) > 0, failures).alias("failed")
    )
