"""Line deduplication by a fixed-depth tree of log templates.

A line's leaf is its token count and leading tokens, variable ones (with a digit) masked. In a leaf, a token that few
texts have at a place is a variable field; the line with its variable fields masked is its template. Templates that
recur across texts and are constant enough are dropped from every document but the first that has them.

All counting is by distinct line: a line that a third of all documents share is one row with a count, from partial
aggregations. Leaves with too few lines go before any token is looked at, and the others
have numbers. Where an occurrence must meet its line's
decision, both sides are freshly exchanged tables, so that adaptive execution can split a hot line; these joins are
merged at every size, as their smaller sides grow with the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideline.llm.common import materialize

MASK = "<*>"
#: A token with a digit; tried at token starts only, so that long tokens cost no more than their length.
VARIABLE = "(?<![^ ])[^ 0-9]*+[0-9][^ ]*"


def _mask(c: Column) -> Column:
    return F.when(c.rlike("[0-9]"), F.regexp_replace(c, VARIABLE, MASK)).otherwise(c)


def _without(lines: Column, drop: Column) -> Column:
    """The text of the lines that stay; lines is bound to a variable, as a lambda would split the text again for each of them."""
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop)
    return F.get(F.transform(F.array(lines), lambda all_lines: F.array_join(F.transform(stay, lambda i: F.get(all_lines, i)), "\n")), F.lit(0))


def recurring(docs: DataFrame, doc_id: str, text: str, *, min_tokens: int, leading: int, min_texts: int, long_tokens: int, similarity: float) -> DataFrame:
    """doc_id, body, at: the occurrences (line numbers from 0, of the text that hashes to body) that line_dedup() drops."""
    bodies = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("body"), F.col(text).alias("text"))
    lines = bodies.select("doc_id", "body", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    if min_tokens > 1:  # looks no further than it has to
        lines = lines.where(F.octet_length(F.substring_index("line", " ", min_tokens - 1)) < F.octet_length("line"))
    size = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    lines = lines.withColumn("size", size).withColumn("words", F.concat_ws(" ", F.col("size").cast("string"), _mask(F.substring_index("line", " ", leading))))
    least = F.when(F.col("size") >= long_tokens, 2).otherwise(min_texts)  # a leaf's lines have one size
    many = lines.groupBy("words", "size").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    many, _ = materialize(many.select("words", F.monotonically_increasing_id().alias("leaf")), "leaves")
    held, _ = materialize(lines.join(many.hint("merge"), "words").select("doc_id", "body", "at", "leaf", "size", "line"), "lines")

    texts = held.select("leaf", "size", "line", "body").distinct().groupBy("leaf", "size", "line").agg(F.count("*").alias("texts"))
    distinct, _ = materialize(texts.withColumn("id", F.monotonically_increasing_id()), "distinct")
    tokens = distinct.select("id", "leaf", "size", "texts", F.posexplode(F.split(_mask(F.col("line")), " ")).alias("place", "token"))
    support = tokens.groupBy("leaf", "size", "place", "token").agg(F.sum("texts").alias("support")).where((F.col("support") >= least) & (F.col("token") != MASK))
    constant, _ = materialize(support.drop("support", "size"), "constants")
    kept = tokens.join(constant, ["leaf", "place", "token"]).groupBy("id").agg(F.count("*").alias("constants"), F.sort_array(F.collect_list(F.struct("place", "token"))).alias("template"))
    enough = (F.col("constants") >= min_tokens) & (F.col("constants") >= F.ceil(F.col("size") * similarity))
    shaped, _ = materialize(distinct.join(kept, "id").where(enough).select("leaf", "size", "line", F.xxhash64("leaf", "template").alias("template")), "templates")
    found, _ = materialize(held.drop("size").join(shaped.hint("merge"), ["leaf", "line"]).select("template", "size", "doc_id", "body", "at"), "occurrences")

    this = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "body", "at")
    across = found.select("template", "size", "body").distinct().groupBy("template", "size").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    first, _ = materialize(found.groupBy("template").agg(F.min(this).alias("first")).join(across.select("template"), "template"), "recurring")
    return found.join(first.hint("merge"), "template").where(~this.eqNullSafe(F.col("first"))).select("doc_id", "body", "at")


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, min_tokens: int = 5, leading: int = 3, min_texts: int = 3, long_tokens: int = 50, similarity: float = 0.8, counts: bool = False) -> DataFrame:
    """docs with the recurring lines taken out of text (and, with counts, n_lines and dropped_lines).

    A template recurs when its lines occur in min_texts different texts or more, or with long_tokens tokens in two (exact
    copies of a text count once); its first line, by doc_id and place, stays. A line's template needs min_tokens constant
    tokens and a share of similarity of all its tokens; shorter lines always stay. Tokens are what stands between single
    spaces, lines what stands between newlines. A null text stays null and has no lines; an empty one has one empty line;
    null ids come after others; rows that repeat id and text lose the same lines. Other columns, whatever their names,
    stay as they are (with counts, those of its names are replaced); no rows give none.
    """
    number = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in number.items()])
    key, body = number[doc_id], number[text]
    drops = recurring(plain, key, body, min_tokens=min_tokens, leading=leading, min_texts=min_texts, long_tokens=long_tokens, similarity=similarity)
    drops, _ = materialize(drops.groupBy("doc_id", "body").agg(F.collect_set("at").alias("_drop")), "drops")
    drops = drops.select(F.col("doc_id").alias("_id"), F.col("body").alias("_body"), "_drop")
    joined = plain.join(drops.hint("merge"), plain[key].eqNullSafe(drops["_id"]) & (F.xxhash64(plain[body]) == drops["_body"]), "left")
    lines = F.split(F.col(body), "\n")
    cut = F.when(F.col("_drop").isNull(), F.col(body)).otherwise(_without(lines, F.col("_drop")))
    more = {"n_lines": F.coalesce(F.array_size(lines), F.lit(0)).cast("long"), "dropped_lines": F.coalesce(F.array_size("_drop"), F.lit(0)).cast("long")} if counts else {}
    kept = [(cut if c == text else F.col(n)).alias(c) for c, n in number.items() if c not in more]
    return joined.select(*kept, *[c.alias(n) for n, c in more.items()])
