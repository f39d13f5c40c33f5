"""Similar past questions by TF-IDF, and the complaints attached to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridledger.operators.feedback import negative_feedback
from gridledger.session import new_table_dir

# Tokens are runs of two or more letters, digits or underscores, lower case.
TOKEN = r"[\p{L}\p{N}_]{2,}"
# Distances of exact copies differ by the order of summation, by about 1e-15: that noise is rounded
# away before ranking, real differences are not.
DISTANCE_PLACES = 12


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _not_blank(docs: DataFrame, text: str) -> DataFrame:
    return docs.filter(F.col(text).isNotNull() & (F.col(text) != ""))


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, tf) over whole texts.

    Texts are laid out by key before they are cut up: a text is several times smaller than its
    (key, token) rows, and the counts of a text then need no shuffle of their own.
    """
    return (
        docs.select(key, text)
        .repartition(key)
        .select(key, F.explode(tokens(F.col(text))).alias("token"))
        .groupBy(key, "token")
        .agg(F.count("*").alias("tf"))
    )


def _inverse(df: Column, docs: DataFrame, text: str) -> Column:
    """idf = ln((1 + n) / (1 + df)) + 1."""
    n_docs = _not_blank(docs, text).agg(F.count("*")).scalar()
    return F.log((1 + n_docs) / (1 + df)) + 1


def _document_frequencies(counts: DataFrame) -> DataFrame:
    return counts.groupBy("token").agg(F.count("*").alias("df"))


def inverse_frequencies(counts: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(token, idf) with idf = ln((1 + n) / (1 + df)) + 1."""
    return _document_frequencies(counts).select("token", _inverse(F.col("df"), docs, text).alias("idf"))


def _unit_vectors(counts: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    # No hint: the vocabulary grows with the corpus, and adaptive execution knows its size. The window
    # covers the distinct tokens of one text, never a whole token's postings.
    weighted = counts.join(idf, "token").select(
        key, "token", (F.col("tf") * F.col("idf")).alias("raw")
    )
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy(key)))
    return weighted.select(key, "token", (F.col("raw") / norm).alias("weight"))


OFTEN = 1 << 22  # tokens at most whose frequencies go to every task; by far fewer in running text


def tfidf(docs: DataFrame, key: str = "id", text: str = "query", often: int = OFTEN) -> DataFrame:
    """Sparse unit vectors (key, token, weight) of all non-blank texts.

    Frequent tokens make up most counts, and their frequencies are few enough to go to every task: those
    counts stay with their text. Only counts of other tokens are moved, to the rest of their token, which
    is a small share of all, and back to the text.
    """
    # Within a struct a missing key equals another one, as in a grouping.
    counts = term_counts(docs.select(F.struct(key).alias("of"), text), "of", text)
    # Three characters and more for each counted token bound the tokens that are as frequent as this.
    room = docs.agg(F.sum(F.length(text) + 1) / 3).scalar()
    most = _kept(_document_frequencies(counts).filter(F.col("df") * often >= room), "often")

    def entries(weighted: DataFrame, name: str) -> DataFrame:
        raw = F.col("tf") * _inverse(F.col("df"), docs, text)
        entry = F.when(F.col("df").isNotNull(), F.struct("token", raw.alias("raw"))).alias("entry")
        # Rows without a frequency leave nulls, which lists and sums pass over.
        return weighted.select("of", entry).groupBy("of").agg(
            F.collect_list("entry").alias(name),
            F.coalesce(F.sum(F.col("entry.raw") * F.col("entry.raw")), F.lit(0.0)).alias(f"{name}_squares"),
        )

    rest = counts.join(most, "token", "left_anti").withColumn("df", F.count("*").over(W.partitionBy("token")))
    whole = entries(counts.join(most, "token", "left"), "near").join(entries(rest, "far"), "of", "left")
    length = F.sqrt(F.col("near_squares") + F.coalesce("far_squares", F.lit(0.0)))
    both = F.when(F.col("far").isNull(), F.col("near")).otherwise(F.concat("near", "far"))
    return whole.select("of", length.alias("length"), F.explode(both).alias("entry")).select(
        F.col("of")[key].alias(key), "entry.token", (F.col("entry.raw") / F.col("length")).alias("weight")
    )


def _kept(frame: DataFrame, name: str) -> DataFrame:
    """The frame, written below the shared folder: read several times, and of a size that Spark knows."""
    spark = frame.sparkSession
    path = new_table_dir(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def _vectors_and_asked(
    questions: DataFrame, docs: DataFrame, question_key: str, question_text: str, key: str, text: str
) -> tuple[DataFrame, DataFrame]:
    """Vectors of the texts, and those of the questions (question, token, asked_weight), written.

    Frequencies are written as well: both sides need them, and as a plan they would be worked out twice.
    """
    counts = term_counts(docs, key, text)
    idf = _kept(inverse_frequencies(counts, docs, text), "idf")
    asked = _unit_vectors(term_counts(questions, question_key, question_text), idf, question_key)
    return _unit_vectors(counts, idf, key), _kept(asked.withColumnRenamed("weight", "asked_weight"), "asked")


def nearest(
    questions: DataFrame,
    docs: DataFrame,
    k: int = 3,
    question_key: str = "question_id",
    question_text: str = "question",
    key: str = "id",
    text: str = "query",
) -> DataFrame:
    """The `k` texts nearest to each question by squared distance: (question, rank, key, distance).

    Unit vectors give distance = 2 - 2 * dot. Dot products are built from shared tokens only.
    The text vectors are laid out by text, and each text meets the question tokens in place while
    these are few, so scores are complete without another shuffle and every task keeps its own best `k`.
    A text without any token has distance 1 and one without a shared token 2; only the first
    few of each can rank, and just those are added. A question without a known token has no
    nearest text. Ties go to the lower key.
    """
    vectors, asked = _vectors_and_asked(questions, docs, question_key, question_text, key, text)
    scored = (
        vectors.join(asked, "token")
        .groupBy(key, question_key)
        .agg(F.sum(F.col("weight") * F.col("asked_weight")).alias("dot"))
    )
    return _ranked(scored, asked, docs, k, question_key, key, text)


def _ranked(
    scored: DataFrame, asked: DataFrame, docs: DataFrame, k: int, question_key: str, key: str, text: str
) -> DataFrame:
    """The best `k` of the scored pairs (question, key, dot) and of texts that share no token."""
    scored = scored.select(question_key, key, (2 - 2 * F.col("dot")).alias("distance"))
    has_token = F.col(text).rlike(TOKEN)
    spare = (
        _not_blank(docs, text)
        .select(F.col(key).alias("spare_key"), has_token.alias("has_token"))
        .withColumn("pos", F.row_number().over(W.partitionBy("has_token").orderBy("spare_key")))
        .filter(F.col("pos") <= 2 * k)
        .agg(
            F.collect_list(
                F.struct("spare_key", F.when(F.col("has_token"), 2.0).otherwise(1.0).alias("far"))
            )
        )
        .scalar()
    )
    unrelated = (
        asked.select(question_key)
        .distinct()
        .select(question_key, F.inline(spare))
        .select(question_key, F.col("spare_key").alias(key), F.col("far").alias("distance"))
    )
    candidates = (
        scored.withColumn("matched", F.lit(True))
        .unionByName(unrelated.withColumn("matched", F.lit(False)))
        .select(
            question_key,
            key,
            F.round(F.greatest("distance", F.lit(0.0)), DISTANCE_PLACES).alias("distance"),
            "matched",
        )
    )
    # A spare text that does share a token is listed twice; its true distance is the smaller.
    best = W.partitionBy(question_key).orderBy("distance", key, F.desc("matched"))
    ranked = candidates.withColumn("pos", F.row_number().over(best)).filter(
        F.col("pos") <= 2 * k
    )
    once = ranked.groupBy(question_key, key).agg(F.min("distance").alias("distance"))
    order = W.partitionBy(question_key).orderBy("distance", key)
    return (
        once.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select(question_key, "rank", key, "distance")
    )


# --- pruned search ---------------------------------------------------------------------

BLOCK_TEXTS = 4096  # texts of a posting block
SLACK = 1e-9  # far more than the noise of summing a dot product, far less than a real difference


def posting_blocks(vectors: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Postings (token, block, key, weight) and blocks (token, block, top, n), ordered by impact.

    A token's texts are cut by levels of weight, each an eighth of an octave, and a level of many texts
    by a hash of the key: no block holds much more than `BLOCK_TEXTS`, however frequent the token.
    """
    leveled = vectors.withColumn("level", F.floor(-8 * F.log2("weight")).cast("int"))
    sizes = leveled.groupBy("token", "level").agg(F.ceil(F.count("*") / BLOCK_TEXTS).alias("pieces"))
    postings = leveled.join(sizes, ["token", "level"]).select(
        "token",
        F.struct("level", F.pmod(F.xxhash64(key), F.col("pieces")).alias("piece")).alias("block"),
        key,
        "weight",
    )
    blocks = postings.groupBy("token", "block").agg(
        F.max("weight").alias("top"), F.min("weight").alias("low"), F.count("*").alias("n")
    )
    return postings, blocks


SKIPPED = 0.4  # share of the floor that the tokens of a question which propose no texts may reach together


def pruned_candidates(
    postings: DataFrame, blocks: DataFrame, asked: DataFrame, k: int, question_key: str, key: str
) -> DataFrame:
    """(question, key) pairs that can still be among the `k` best; all others are never scored.

    A floor for each question comes from the texts that its strongest tokens find: the k-th best of their
    scores. The question's most frequent tokens are set aside as long as their joint length stays below a share
    of the floor: vectors are of length one, so a text that shares only those cannot reach it (Cauchy-Schwarz).
    What the other tokens add to a text is summed; those set aside can add at most their length times the
    length that the text has left.

    Terms and seeds are written, so that they meet the postings in place while they are few.
    """
    tops = blocks.groupBy("token").agg(F.max("top").alias("most"), F.sum("n").alias("texts"))
    terms = _kept(
        asked.join(tops, "token").withColumn("bound", F.col("asked_weight") * F.col("most")), "terms"
    )
    before = W.partitionBy(question_key).orderBy(F.desc("bound"), "token").rowsBetween(W.unboundedPreceding, -1)
    # Windows cover the tokens of one question.
    strong = terms.filter(F.col("bound") > 0).withColumn(
        "held", F.coalesce(F.sum("texts").over(before), F.lit(0))
    ).filter(F.col("held") < 16 * k)
    partial = (
        postings.join(_kept(strong.select("token", question_key, "asked_weight"), "strong"), "token")
        .groupBy(question_key, key)
        .agg(F.sum(F.col("weight") * F.col("asked_weight")).alias("dot"))
    )
    best = W.partitionBy(question_key).orderBy(F.desc("dot"))
    seeds = partial.withColumn("pos", F.row_number().over(best)).filter(F.col("pos") <= 8 * k)
    floors = (
        _kept(seeds.select(question_key, key).join(asked, question_key), "seeds")
        .join(postings, [key, "token"])
        .groupBy(question_key, key)
        .agg(F.sum(F.col("weight") * F.col("asked_weight")).alias("dot"))
        .withColumn("pos", F.row_number().over(best))
        .filter(F.col("pos") <= k)
        .groupBy(question_key)
        .agg(F.min("dot").alias("least"), F.count("*").alias("found"))
        .select(question_key, F.when(F.col("found") == k, F.col("least") - SLACK).otherwise(F.lit(0.0)).alias("floor"))
    )
    often_first = W.partitionBy(question_key).orderBy(F.desc("texts"), "token")
    length = F.sqrt(F.sum(F.col("asked_weight") * F.col("asked_weight")).over(often_first))
    split = terms.join(floors, question_key).withColumn("length", length).withColumn(
        "aside", F.when(F.col("length") < SKIPPED * F.col("floor"), F.col("length")).otherwise(F.lit(0.0))
    ).withColumn("left", F.max("aside").over(W.partitionBy(question_key)))
    read = _kept(
        split.filter("aside = 0").select(question_key, "token", "asked_weight", "floor", "left"), "read"
    )
    weight = F.col("weight")
    reach = F.col("dot") + F.col("left") * F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("square")))
    return (
        postings.join(read, "token")
        .groupBy(question_key, key)
        .agg(
            F.sum(weight * F.col("asked_weight")).alias("dot"), F.sum(weight * weight).alias("square"),
            F.max("left").alias("left"), F.max("floor").alias("floor"),
        )
        .filter(reach >= F.col("floor"))
        .select(question_key, key)
    )


def nearest_pruned(
    questions: DataFrame,
    docs: DataFrame,
    k: int = 3,
    question_key: str = "question_id",
    question_text: str = "question",
    key: str = "id",
    text: str = "query",
) -> DataFrame:
    """The rows of `nearest`, without scoring pairs that cannot be among the `k` best.

    Vectors, postings and candidates are written below the shared folder, as each is read several times. Only
    tokens that are asked for are kept of the vectors, and postings lie by text: what a text adds up to is
    summed before it is shuffled.
    """
    vectors, asked = _vectors_and_asked(questions, docs, question_key, question_text, key, text)
    wanted = _kept(asked.select("token").distinct(), "wanted")
    vectors = _kept(vectors.join(wanted, "token", "left_semi"), "vectors")
    postings, blocks = posting_blocks(vectors, key)
    postings, blocks = _kept(postings.repartition(key), "postings"), _kept(blocks, "blocks")
    pairs = _kept(pruned_candidates(postings, blocks, asked, k, question_key, key), "pairs")
    scored = (
        pairs.join(asked, question_key)
        .join(vectors, [key, "token"])
        .groupBy(key, question_key)
        .agg(F.sum(F.col("weight") * F.col("asked_weight")).alias("dot"))
    )
    return _ranked(scored, asked, docs, k, question_key, key, text)


def feedback_insights(questions: DataFrame, logs: DataFrame, k: int = 3) -> DataFrame:
    """Complaints among the `k` nearest past questions, in distance order.

    The verdict is looked at after the nearest texts are chosen, so a question may get fewer
    than `k` insights.
    """
    near = nearest(questions, logs, k)
    bad = negative_feedback(logs)
    text = F.concat(
        F.lit("Previous issue: "), F.col("query"), F.lit(" - "), F.col("feedback_comment")
    )
    return near.join(bad, "id").select("question_id", "rank", "id", text.alias("insight"))
