"""The queries of the ten problems, each over its whole tables.

The tables' keys are unique, so rows are distinct without a shuffle to make them so.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import copies, encoding, forms, leaks, mixing, neighbours, pairs, sentences, splitting
from termloom.session import cut, small_side, table


def p1_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every wrongly decoded field with its chain, posterior and restored text."""
    return encoding.garbled(table(spark, sf_dir, "string_rows"), "row_idx", "plugin", ["source", "dest"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of string_rows whose text was decoded with the wrong encoding."""
    return p1_repairs(spark, sf_dir).select("row_idx", "field")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of string_rows in pieces within its provider's limit."""
    return splitting.split_items(table(spark, sf_dir, "string_rows"), table(spark, sf_dir, "split_limits"), "row_idx", "source", "provider")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of string_rows whose source had to be split."""
    return p2_pieces(spark, sf_dir).filter("piece = 1").select("row_idx")


#: Width of the vectors of vector_index that take part.
WIDTH = 96


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar others of every vector."""
    return neighbours.nearest(table(spark, sf_dir, "vector_index"), "pos", "embedding", WIDTH)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of which one has the other among its five most similar, at a cosine of 0.75 or more."""
    got = p3_neighbours(spark, sf_dir).filter("cosine >= 0.75")
    return got.select(F.least("pos", "other").alias("pos_a"), F.greatest("pos", "other").alias("pos_b")).distinct()


def p3_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar others of every vector whose pos is divisible by 100, by greedy walks on the graph."""
    vectors = cut(neighbours.usable(table(spark, sf_dir, "vector_index"), "pos", "embedding", WIDTH), "search-vectors")
    nodes, members = neighbours.distinct_vectors(vectors)
    nodes, members = cut(nodes, "search-nodes"), cut(members, "search-members")
    graph = neighbours.knn_graph(nodes, WIDTH)
    asked = vectors.filter("key % 100 = 0").select(F.col("key").alias("query"), "v")
    return neighbours.rows_of(neighbours.greedy_search(asked, nodes, graph, k=6), members, 5)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "string_rows").select(F.lit("string_rows").alias("tbl"), F.col("row_idx").alias("key"), "id", "source")
    raw = copies.parse_records(table(spark, sf_dir, "raw_records"), "rec_id", "xml")
    return rows.unionByName(raw.withColumn("tbl", F.lit("raw_records")))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each distinct String record with its number of copies."""
    return copies.copies(_records(spark, sf_dir), ["id", "source"])[0].select("tbl", F.col("least").alias("key"), F.col("n").alias("n_copies"))


def p4_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for string_rows alone."""
    return copies.copies(_records(spark, sf_dir).filter("tbl = 'string_rows'"), ["id", "source"])[0].select(F.col("least").alias("row_idx"), F.col("n").alias("n_copies"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record that is a copy of one with a smaller key."""
    return copies.copies(_records(spark, sf_dir), ["id", "source"])[1]


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows sent to the translator as pairs; sources stand repaired, responses that p1 finds are left out."""
    rows = table(spark, sf_dir, "string_rows").select("row_idx", "plugin", "source", "dest", "provider", "attempt")
    fixed = cut(encoding.garbled(rows, "row_idx", "plugin", ["source", "dest"]), "pairs-repairs")
    source = small_side(fixed.filter("field = 'source'").select("row_idx", F.col("restored").alias("_fixed")))
    bad = small_side(fixed.filter("field = 'dest'").select("row_idx"))
    langs = table(spark, sf_dir, "plugins").select("plugin", "src_lang", "dst_lang").dropDuplicates(["plugin"])
    sent = rows.filter("attempt >= 1").join(bad, "row_idx", "left_anti").join(source, "row_idx", "left").join(langs, "plugin", "left")
    return sent.select(
        F.col("row_idx").alias("key"), F.col("provider").alias("src"), F.coalesce("_fixed", "source").alias("prompt"),
        F.col("dest").alias("response"), F.col("src_lang").alias("prompt_lang"), F.col("dst_lang").alias("lang"),
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every defective pair of string_rows with its defect."""
    return pairs.defects(_pairs(spark, sf_dir)).select(F.col("key").alias("row_idx"), "defect").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of string_rows whose translation stops early."""
    return pairs.truncated(_pairs(spark, sf_dir)).select(F.col("key").alias("row_idx")).distinct()


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every provider its translations, those that are cut, and their share."""
    sent = _pairs(spark, sf_dir)
    short = pairs.truncated(sent).withColumn("_cut", F.lit(1))
    return (
        sent.join(short, "key", "left").groupBy(F.col("src").alias("provider"))
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.coalesce("_cut", F.lit(0))).alias("n_cut"))
        .withColumn("share_cut", F.col("n_cut") / F.col("n_rows"))
    )


def p7_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every source and glossary term that isn't in it."""
    rows = forms.odd_forms(table(spark, sf_dir, "string_rows"), "row_idx", "source").withColumn("tbl", F.lit("string_rows"))
    terms = forms.odd_forms(table(spark, sf_dir, "glossary"), "ord", "term").withColumn("tbl", F.lit("glossary"))
    return rows.unionByName(terms).select("tbl", "key", "form")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with characters that stand in for ordinary ones; wrongly decoded sources aren't cases."""
    garbled = encoding.garbled(table(spark, sf_dir, "string_rows"), "row_idx", "plugin", ["source"])
    bad = garbled.select(F.lit("string_rows").alias("tbl"), F.col("row_idx").alias("key"))
    return p7_forms(spark, sf_dir).join(bad, ["tbl", "key"], "left_anti").select("tbl", "key")


def p8_passages(spark: SparkSession, sf_dir: str, slack: int = 3) -> DataFrame:
    """Every passage of an evaluation item in a document, exact or in close order."""
    return leaks.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), "doc_id", "text", "item_id", "text", "lang", slack=slack)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the items of which they hold an exact passage."""
    return p8_passages(spark, sf_dir, slack=0).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).distinct()


#: Vocabulary of a public tokenizer; another path may be given.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def _mixed(spark: SparkSession, sf_dir: str, vocabulary: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), "doc_id", "source", "text", vocabulary)


def p9_mix(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The drawn documents with their copies."""
    return _mixed(spark, sf_dir, vocabulary)[0].withColumnRenamed("key", "doc_id")


def p9_shares(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Target and actual share of every source."""
    return _mixed(spark, sf_dir, vocabulary)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence unit of every document."""
    return sentences.sentence_units(table(spark, sf_dir, "documents"), "doc_id", "text", "lang").select("doc_id", "start_char", "end_char")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries whose names begin with p and a problem's number."""
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """SQL for those that SQL can express."""
    words = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"

    def grams(table: str, key: str, tokens: str, n: int, keep: str) -> str:
        runs = f"list_transform(range(1, len(t) - {n - 2}), lambda i: array_to_string(t[i:i + {n - 1}], ' '))"
        return f"SELECT {key}, unnest({runs}) AS gram FROM (SELECT {key}, {tokens} AS t FROM {table} WHERE text IS NOT NULL AND {keep})"

    signs = f"string_split(array_to_string({words}, ''), '')"
    by_sign = "lang IN ('zh', 'ja')"
    return {
        "p2_found": """SELECT row_idx FROM string_rows s WHERE length(source) > coalesce(
            (SELECT max_chars FROM split_limits l WHERE l.provider = coalesce(s.provider, '*')), (SELECT max_chars FROM split_limits l WHERE l.provider = '*'))""",
        "p4_row_groups": r"""SELECT min(row_idx) AS row_idx, count(*) AS n_copies FROM (SELECT row_idx,
            regexp_replace(lower(id), '[^\p{L}\p{N}]+', '', 'g') AS i, regexp_replace(lower(source), '[^\p{L}\p{N}]+', '', 'g') AS s FROM string_rows)
            WHERE i <> '' AND s <> '' GROUP BY i, s""",
        "p8_found": f"""SELECT DISTINCT doc_id, item_id FROM ({grams("documents", "doc_id", words, 12, "true")}) d
            JOIN ({grams("eval_items", "item_id", words, 12, f"coalesce(NOT {by_sign}, true)")}) i USING (gram)
            UNION SELECT DISTINCT doc_id, item_id FROM ({grams("documents", "doc_id", signs, 20, "true")}) d
            JOIN ({grams("eval_items", "item_id", signs, 20, by_sign)}) i USING (gram)""",
    }
