"""Classification by rule tables: vocabularies of any size, given as rows instead of branches.

A rule has a key (a code, an ending or a word), a label and a priority; of several rules that fit, the least priority
wins, then the smallest label. `classify` compiles short fixed lists into one expression; a chain of thousands of branches does not
compile, so here the rules are joined. What is matched are the column's distinct values, each once, however often it occurs;
the labels then go back to the rows. Matching ignores case, as `classify` does, except for codes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fhirlake.sources.shared import through_table

#: A side of a join is sent to all tasks up to so many bytes of strings, measured before.
BROADCAST_BYTES = 16 << 20
#: Words are found by a part of so many characters: the most that the word has, so at least half of it up to 48.
GRAMS = (1, 2, 3, 6, 12, 24)


def _best(rules: DataFrame, key: str) -> DataFrame:
    """`key`, `label`, `priority`: the winning rule of each key; rules without key or label are left out."""
    given = rules.filter(F.col(key).isNotNull() & F.col("label").isNotNull())
    return given.groupBy(key).agg(F.min(F.struct("priority", "label")).alias("rule")).select(key, "rule.label", "rule.priority")


def _small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its strings are measured to be few; joined as any other table beyond that.

    `df` is a written table, so measuring it does not compute it a second time, and its join is one of plain
    shuffles, in which adaptive execution can split a frequent value.
    """
    strings = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if f.dataType.simpleString() == "string"]
    size = df.agg(F.sum(sum(strings, F.lit(16)).cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _labelled(df: DataFrame, column: str, found: DataFrame, name: str, default: str | None) -> DataFrame:
    """`df` with the labels of its values (`__value`, `__label`)."""
    joined = df.join(_small(through_table(found, "vocabulary-found")), F.col(column) == F.col("__value"), "left")
    return joined.withColumn(name, F.coalesce("__label", F.lit(default).cast("string"))).drop("__value", "__label")


def _values(df: DataFrame, column: str) -> DataFrame:
    values = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("__value")).distinct()
    return through_table(values.withColumn("__text", F.lower("__value")), "vocabulary-values")


def _winners(matches: DataFrame) -> DataFrame:
    best = F.min(F.struct("priority", "label")).alias("rule")
    return matches.groupBy("__value").agg(best).select("__value", F.col("rule.label").alias("__label"))


def by_code(df: DataFrame, column: str, rules: DataFrame, name: str, default: str | None = None) -> DataFrame:
    """`df` with `name`: the label of the row's code (`code`, `label`, `priority`), else `default`; also for a NULL code."""
    found = _best(rules, "code").select(F.col("code").alias("__value"), F.col("label").alias("__label"))
    return _labelled(df, column, found, name, default)


def by_suffix(df: DataFrame, column: str, rules: DataFrame, name: str, default: str | None = None) -> DataFrame:
    """`df` with `name`: the label of an ending of the text (`suffix`, `label`, `priority`), else `default`.

    A text is looked up with its endings of the lengths that occur among the rules, so its cost grows with the
    number of different lengths and not with the number of rules. An empty suffix fits every text that is not NULL.
    """
    best = through_table(_best(rules.withColumn("suffix", F.lower("suffix")), "suffix"), "vocabulary-rules")
    lengths = sorted(r[0] for r in best.select(F.length("suffix")).distinct().collect())  # one number a length
    if not lengths:
        return df.withColumn(name, F.lit(default).cast("string"))
    fitting = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("__text"))
    ends = F.transform(fitting, lambda n: F.substring(F.col("__text"), F.length("__text") - n + 1, n))
    asked = _values(df, column).select("__value", F.explode(ends).alias("suffix"))
    return _labelled(df, column, _winners(asked.join(_small(best), "suffix")), name, default)


def _grams(text: Column, size: Column | int) -> Column:
    n = F.lit(size) if isinstance(size, int) else size
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1))
    # eight bytes however long a part is; texts that meet a word by equal hashes are searched for it all the same
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.substring(text, i, n))))


def _part_size(word: Column) -> Column:
    return F.array_max(F.filter(F.array(*map(F.lit, GRAMS)), lambda n: n <= F.length(word)))


def by_substring(df: DataFrame, column: str, rules: DataFrame, name: str, default: str | None = None) -> DataFrame:
    """`df` with `name`: the label of a word that occurs anywhere in the text (`word`, `label`, `priority`), else `default`.

    Each word is posted under one of its parts of a size in `GRAMS`, the largest that it has, and of these that which fewest
    texts hold. A text is looked up with its own parts of all sizes in use, and only words that share one are searched for in it. Parts
    grow with the words: of one size, however rare, they would be shared by ever more words and texts as both tables grow. Words
    overlap freely. An empty word fits every text that is not NULL.
    """
    best = through_table(_best(rules.withColumn("word", F.lower("word")), "word"), "vocabulary-rules")
    if best.isEmpty():
        return df.withColumn(name, F.lit(default).cast("string"))
    sizes = [r[0] for r in best.filter("word <> ''").select(_part_size(F.col("word"))).distinct().collect()]  # of `GRAMS`
    values = _values(df, column)
    none = F.array().cast("array<bigint>")
    own = F.concat(none, *(F.coalesce(_grams(F.col("__text"), n), none) for n in sizes))
    parts = through_table(values.select("__value", F.explode(own).alias("gram")), "vocabulary-grams")

    used = best.filter("word <> ''").select("word", F.explode(_grams(F.col("word"), _part_size(F.col("word")))).alias("gram"))
    used = through_table(used, "vocabulary-posted")
    held = parts.join(_small(used.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("texts"))
    rarest = Window.partitionBy("word").orderBy("texts", "gram")
    posted = used.join(held, "gram").withColumn("place", F.row_number().over(rarest)).filter("place = 1")
    # a word of which some part is in no text is in none
    whole = used.groupBy("word").agg(F.count("*").alias("parts"))
    seen = used.join(held, "gram").groupBy("word").agg(F.count("*").alias("parts"))
    possible = seen.join(whole, ["word", "parts"]).select("word")
    posted = posted.join(possible, "word").join(best, "word").select("gram", "word", "label", "priority")
    posted = through_table(posted, "vocabulary-posted")

    met = parts.join(_small(posted), "gram").filter(F.contains(F.lower("__value"), F.col("word")))
    matches = met.select("__value", "label", "priority")
    always = best.filter("word = ''").first()  # the one rule without a word
    if always is not None:
        everywhere = values.select("__value", F.lit(always["label"]).alias("label"), F.lit(always["priority"]).alias("priority"))
        matches = matches.unionByName(everywhere)
    return _labelled(df, column, _winners(matches), name, default)


def first_of(df: DataFrame, name: str, *steps: Callable[[DataFrame, str], DataFrame], default: str | None = None) -> DataFrame:
    """`df` with `name`: the first label that a step gives, in order, else `default`.

    A step adds a column to a table, such as ``lambda d, n: by_code(d, "loinc_code", rules, n)``.
    """
    columns = []
    out = df
    for number, step in enumerate(steps):
        columns.append(f"__step{number}")
        out = step(out, columns[-1])
    return out.withColumn(name, F.coalesce(*columns, F.lit(default).cast("string"))).drop(*columns)
