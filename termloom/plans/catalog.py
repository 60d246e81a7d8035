"""Queries of the library's own operators with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.operators import glossary as G
from termloom.operators import qa, retrieve
from termloom.operators import strings as S
from termloom.operators import vectors as V
from termloom import dialogue
from termloom.plans import oracle
from termloom.providers import HashEmbedder, RepeatTranslator, embed_column
from termloom.session import shared_folder, table
from termloom.sources import glossary_io, xml
from termloom.streaming import index_stream

#: Width of the vectors of vector_index.
WIDTH = 96


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "string_rows").select("row_idx", "plugin", "id", "source", "dest", "attempt", "provider")


def _glossary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "glossary").select("ord", "term", "translation")


def _index(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vector_index").select("pos", "term", "embedding")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).filter("source is not null and dest is not null").select("row_idx", "source", "dest", "attempt")


# -- scalar functions ---------------------------------------------------------


def proper_noun_keywords(spark: SparkSession, d: str) -> DataFrame:
    """(keyword, n_docs): capitalised words of all documents."""
    kw = retrieve.keywords(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return kw.groupBy("keyword").agg(F.count(F.lit(1)).alias("n_docs"))


def first_keywords(spark: SparkSession, d: str) -> DataFrame:
    """(row_idx, kw_pos, keyword): keywords of every source, first spelling kept, in order."""
    return retrieve.keywords(_rows(spark, d), "row_idx", "source")


def possessive_strip(spark: SparkSession, d: str) -> DataFrame:
    """(ord, term, stripped): glossary terms without possessives."""
    return _glossary(spark, d).select("ord", "term", T.strip_possessive(F.col("term")).alias("stripped"))


def keyword_union(spark: SparkSession, d: str) -> DataFrame:
    """(row_idx, keywords): a model's keywords (here: the id's parts) before those of the text, distinct without regard to case."""
    r = _rows(spark, d).filter("source is not null")
    given = F.coalesce(F.split("id", "_"), F.array().cast("array<string>"))
    return r.select("row_idx", F.array_join(T.distinct_ci(F.concat(given, T.proper_nouns(F.col("source")))), "|").alias("keywords"))


def english_words(spark: SparkSession, d: str) -> DataFrame:
    """(row_idx, words): English words of every source outside markup and placeholders."""
    return _rows(spark, d).filter("source is not null").select("row_idx", F.array_join(T.english_words(F.col("source")), " ").alias("words"))


def strip_markup(spark: SparkSession, d: str) -> DataFrame:
    """(row_idx, bare): sources without tags and placeholders."""
    return _rows(spark, d).filter("source is not null").select("row_idx", T.strip_placeholders(T.strip_tags(F.col("source"))).alias("bare"))


def strip_blanks(spark: SparkSession, d: str) -> DataFrame:
    """(row_idx, norm): normalised key of every source."""
    return _rows(spark, d).filter("source is not null").select("row_idx", T.norm_key(F.col("source")).alias("norm"))


def detect_language(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, code, language): script language of every document and its name."""
    code = T.detect_language(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", code.alias("code"), T.language_display_name(code).alias("language"))


def language_names(spark: SparkSession, d: str) -> DataFrame:
    """(lang, language, n_docs): stored languages with their names; unknown codes stand for themselves."""
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs")).select("lang", T.language_display_name(F.col("lang")).alias("language"), "n_docs")


def token_count(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, n_tokens): tokens of every document."""
    return table(spark, d, "documents").filter("text is not null").select("doc_id", T.token_count(F.col("text")).alias("n_tokens"))


def truncate_reference(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, excerpt): every document cut to 12 tokens around its own eighth token."""
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", "text")
    anchor = F.array(F.coalesce(F.get(T.tokens(F.col("text")), F.lit(7)), F.lit("")))
    return docs.select("doc_id", T.truncate_reference(F.col("text"), anchor, 12).alias("excerpt"))


def find_anchor(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, at): where the first of three anchors stands in every document."""
    anchors = F.array(F.lit(" x "), F.lit("Iron Sword"), F.lit("the"))
    return table(spark, d, "documents").select("doc_id", T.find_anchor(F.col("text"), anchors).alias("at"))


def template_vars(spark: SparkSession, d: str) -> DataFrame:
    """(row_idx, prompt): a template with the names and text of a row filled in; other braces stay."""
    r = _rows(spark, d).filter("source is not null")
    tpl = F.lit('To {lang}: {text} {"keep": "{x}"} by {who}')
    return r.select("row_idx", T.apply_vars(tpl, {"lang": "Chinese", "text": F.col("source"), "who": F.coalesce("provider", F.lit(""))}).alias("prompt"))


def parse_keywords(spark: SparkSession, d: str) -> DataFrame:
    """(row_idx, keywords): keyword lists out of model replies, here built from the rows: fenced, plain and no list."""
    r = _rows(spark, d).filter("id is not null")
    body = F.concat(F.lit('["'), F.regexp_replace("id", '["\\\\]', ""), F.lit('", "B"]'))
    reply = F.when(F.col("row_idx") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("row_idx") % 3 == 1, body).otherwise(F.lit('{"a": 1}'))
    return r.select("row_idx", F.array_join(T.parse_keyword_array(reply), "|").alias("keywords"))


def parse_translation(spark: SparkSession, d: str) -> DataFrame:
    """(row_idx, parsed): the translation out of every stored reply."""
    return _pairs(spark, d).select("row_idx", T.parse_translation(F.col("dest"), F.col("source")).alias("parsed"))


def likely_untranslated(spark: SparkSession, d: str) -> DataFrame:
    """(row_idx, flagged): translations that look untranslated to a check made for ideographic targets."""
    return _pairs(spark, d).select("row_idx", T.likely_untranslated(F.col("source"), F.col("dest")).alias("flagged"))


def untranslated_fragments(spark: SparkSession, d: str) -> DataFrame:
    """(row_idx, fragments): English words that source and translation share."""
    return _pairs(spark, d).select("row_idx", F.array_join(T.untranslated_fragments(F.col("source"), F.col("dest")), ",").alias("fragments"))


def suspicious_fragments(spark: SparkSession, d: str) -> DataFrame:
    """(row_idx, fragments): shared words that touch an ideograph, in translations that repeat the source's second word between ideographs."""
    p = _pairs(spark, d)
    glued = F.concat(F.col("source"), F.lit(" "), F.lit("见"), F.coalesce(F.get(T.english_words(F.col("source")), F.lit(1)), F.lit("")), F.lit("。"))
    return p.select("row_idx", F.array_join(T.suspicious_fragments(F.col("source"), glued), ",").alias("fragments")).filter("fragments <> ''")


def retry_decision(spark: SparkSession, d: str) -> DataFrame:
    """(decision, n_rows): what follows each translation, given its attempts."""
    p = _pairs(spark, d).select(qa.retry_decision(F.col("source"), F.col("dest"), F.col("attempt")).alias("decision"))
    return p.groupBy("decision").agg(F.count(F.lit(1)).alias("n_rows"))


def named_fragments(spark: SparkSession, d: str) -> DataFrame:
    """(row_idx, named): the fragments that a retry would name."""
    return _pairs(spark, d).select("row_idx", qa.named_fragments(F.col("source"), F.col("dest")).alias("named")).filter("named <> ''")


def display_strings(spark: SparkSession, d: str) -> DataFrame:
    """(ord, shown, term_back): glossary entries as shown, and the term taken back from that."""
    shown = T.display_string(F.col("term"), F.col("translation"))
    return _glossary(spark, d).select("ord", shown.alias("shown"), T.term_of_display(shown).alias("term_back"))


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    """(row_idx, line): a log line for every failed or late row at or over WARNING."""
    r = table(spark, d, "string_rows")
    level = F.when(F.col("loaded_at").isNull(), "error").when(F.col("attempt") > 1, "warning").otherwise("debug")
    line = T.log_line(level, F.concat(F.lit("row "), F.col("row_idx").cast("string")), F.coalesce("provider", F.lit("none")), F.lit("load"), F.col("exported_at"))
    return r.filter(T.should_emit(level, "WARNING")).select("row_idx", line.alias("line"))


# -- string tables ------------------------------------------------------------


def translatable_rows(spark: SparkSession, d: str) -> DataFrame:
    """(plugin, n_rows): rows with a source per plugin."""
    return S.translatable(_rows(spark, d)).groupBy("plugin").agg(F.count(F.lit(1)).alias("n_rows"))


def selected_rows(spark: SparkSession, d: str) -> DataFrame:
    """(row_idx, source): translatable rows among those whose first attempt is still due."""
    r = _rows(spark, d)
    return S.selected(r, r.filter("attempt = 0")).select("row_idx", "source")


def dedup_plan(spark: SparkSession, d: str) -> DataFrame:
    """(source, rep_row_idx, n_rows): each distinct source once."""
    return S.dedup_plan(_rows(spark, d))


def dedup_stats(spark: SparkSession, d: str) -> DataFrame:
    """(total, uniq, saved) of the table."""
    return S.dedup_stats(_rows(spark, d))


def fan_out(spark: SparkSession, d: str) -> DataFrame:
    """(row_idx, translation): the representative's dest given to every row of its source."""
    r = _rows(spark, d)
    reps = S.dedup_plan(r).join(r.select(F.col("row_idx").alias("rep_row_idx"), "dest"), "rep_row_idx").select("source", F.coalesce("dest", F.lit("")).alias("translation"))
    return S.fan_out(r, reps).select("row_idx", "translation")


def fill_dest(spark: SparkSession, d: str) -> DataFrame:
    """(row_idx, dest): empty translations filled with the source's glossary translation."""
    r = _rows(spark, d)
    g = G.last_wins(_glossary(spark, d)).select(F.col("term").alias("source"), F.col("translation").alias("t"))
    return r.join(g, "source", "left").select("row_idx", S.fill_dest(F.col("dest"), F.col("t")).alias("dest"))


def clear_dest(spark: SparkSession, d: str) -> DataFrame:
    """(attempt, n_empty, n_rows): after clearing the rows that took three attempts."""
    r = _rows(spark, d)
    return S.clear_dest(r, r.filter("attempt = 3")).groupBy("attempt").agg(F.count(F.when(F.col("dest") == "", 1)).alias("n_empty"), F.count(F.lit(1)).alias("n_rows"))


def progress_metric(spark: SparkSession, d: str) -> DataFrame:
    """(plugin, percent): share of rows that have a translation."""
    done = F.count(F.when(F.coalesce("dest", F.lit("")) != "", 1))
    return _rows(spark, d).groupBy("plugin").agg(done.alias("_done"), F.count(F.lit(1)).alias("_all")).select("plugin", T.progress(F.col("_done"), F.col("_all")).alias("percent"))


# -- glossary -----------------------------------------------------------------


def glossary_lookup(spark: SparkSession, d: str) -> DataFrame:
    """(norm, term): normalised keys with their first spelling."""
    return G.lookup(_glossary(spark, d)).select("norm", "term")


def glossary_lookup_exact(spark: SparkSession, d: str) -> DataFrame:
    """(row_idx, term): sources that are a glossary term."""
    kws = _rows(spark, d).filter("source is not null").select("row_idx", F.col("source").alias("keyword"))
    return retrieve.exact(kws, _glossary(spark, d)).select("row_idx", "term")


def glossary_containment_top5(spark: SparkSession, d: str) -> DataFrame:
    """(keyword, rank, term): up to five terms that hold each proper noun of the sources, in glossary order."""
    from pyspark.sql.window import Window

    kws = first_keywords(spark, d).select("keyword").distinct()
    w = Window.partitionBy("keyword").orderBy("ord")
    return retrieve.contained(kws, _glossary(spark, d)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= retrieve.TOP_CONTAINED).select("keyword", "rank", "term")


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A glossary and entries to write over it: the first spellings, and every entry with a new translation."""
    g = _glossary(spark, d)
    keep = g.join(G.lookup(g).select("ord"), "ord", "left_semi")
    new = g.select((F.col("ord") + 1_000_000_000).alias("ord"), "term", F.upper("translation").alias("translation"))
    return keep, new


def glossary_upsert(spark: SparkSession, d: str) -> DataFrame:
    """(ord, term, translation): every entry written over the first spellings."""
    return G.upsert(*_halves(spark, d))


def glossary_delete(spark: SparkSession, d: str) -> DataFrame:
    """(ord, term, translation): the glossary without the terms that the index lacks."""
    g = _glossary(spark, d)
    return G.delete(g, G.missing_terms(g, _index(spark, d)))


def glossary_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """(ord, term, translation): source and dest of all rows as entries, last one kept."""
    e = _rows(spark, d).filter("source is not null").select(F.col("row_idx").alias("ord"), F.col("source").alias("term"), F.col("dest").alias("translation"))
    return G.last_wins(e)


def valid_entries(spark: SparkSession, d: str) -> DataFrame:
    """(ord, term, translation): entries with both sides."""
    return G.valid_entries(_glossary(spark, d))


def missing_terms(spark: SparkSession, d: str) -> DataFrame:
    """(ord, term): entries without a vector."""
    return G.missing_terms(_glossary(spark, d), _index(spark, d)).select("ord", "term")


def glossary_search(spark: SparkSession, d: str) -> DataFrame:
    """(ord, term): entries whose display string holds a phrase."""
    return G.search(_glossary(spark, d), "Gift ->").select("ord", "term")


def glossary_page(spark: SparkSession, d: str) -> DataFrame:
    """(ord, term): the second page."""
    return G.page(_glossary(spark, d), 2).select("ord", "term")


def page_count(spark: SparkSession, d: str) -> DataFrame:
    """(n_terms, n_pages)."""
    return G.page_count(_glossary(spark, d))


# -- vectors and retrieval ----------------------------------------------------


def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    """(pos, norm, unit_norm): length of every usable vector, and after normalising."""
    u = V.usable(_index(spark, d), "pos", "embedding", WIDTH)
    return u.select(F.col("key").alias("pos"), F.round(V.l2_norm(F.col("v")), 6).alias("norm"), F.round(V.l2_norm(V.normalise(F.col("v"))), 6).alias("unit_norm"))


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """(query, pos, rank, score): three entries most similar to every entry whose pos is divisible by 100."""
    ix = _index(spark, d)
    got = V.top_k(ix.filter("pos % 100 = 0"), ix, "pos", "embedding", WIDTH)
    return got.select("query", F.col("key").alias("pos"), "rank", F.round("score", 6).alias("score"))


def vector_threshold(spark: SparkSession, d: str) -> DataFrame:
    """(query, n_close): how many of the three are within the threshold."""
    return vector_topk(spark, d).filter(F.col("score") >= retrieve.THRESHOLD).groupBy("query").agg(F.count(F.lit(1)).alias("n_close"))


def embedding_topk(spark: SparkSession, d: str) -> DataFrame:
    """(query, vec_id, rank): the same over the embeddings table."""
    e = table(spark, d, "embeddings")
    return V.top_k(e.filter("vec_id % 100 = 0"), e, "vec_id", "embedding", 64).select("query", F.col("key").alias("vec_id"), "rank")


def index_integrity(spark: SparkSession, d: str) -> DataFrame:
    """One row of counts that tell whether glossary and index fit."""
    return G.integrity(_glossary(spark, d), _index(spark, d), WIDTH)


def index_delete(spark: SparkSession, d: str) -> DataFrame:
    """(pos, term): the index without the first entry of each term that has several."""
    ix = _index(spark, d)
    twice = ix.filter("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("term")
    return G.delete_from_index(ix, twice).select("pos", "term")


def index_append(spark: SparkSession, d: str) -> DataFrame:
    """(pos, term, width): the index with a vector appended for every missing term."""
    ix = _index(spark, d)
    fresh = embed_column(G.missing_terms(_glossary(spark, d), ix), "term", HashEmbedder(WIDTH))
    return G.append_vectors(ix, fresh).select("pos", "term", F.coalesce(F.size("embedding"), F.lit(-1)).alias("width"))


def index_build(spark: SparkSession, d: str) -> DataFrame:
    """(term, width): an index built by the resumable job; a second run finds nothing to do."""
    at = shared_folder(spark, "index-build")
    for _ in range(2):
        index_stream.build_index(spark, _glossary(spark, d), at, HashEmbedder(WIDTH))
    return index_stream.read_index(spark, at).select("term", F.coalesce(F.size("embedding"), F.lit(-1)).alias("width"))


# -- files --------------------------------------------------------------------


def xml_strings(spark: SparkSession, d: str) -> DataFrame:
    """(id, source, dest): all rows written as XML and read back."""
    at = shared_folder(spark, "strings-xml")
    xml.write_strings(_rows(spark, d), at)
    return xml.read_strings(spark, at).select("id", "source", "dest")


def glossary_json(spark: SparkSession, d: str) -> DataFrame:
    """(ord, term, translation): the glossary written as a JSON object and read back."""
    at = shared_folder(spark, "glossary-json").removeprefix("file://")
    glossary_io.write_json(_glossary(spark, d).filter("term is not null"), at)
    return glossary_io.read_json(spark, at)


def glossary_csv(spark: SparkSession, d: str) -> DataFrame:
    """(term, translation): the glossary written as CSV and imported."""
    at = shared_folder(spark, "glossary-csv")
    _glossary(spark, d).filter("term is not null").orderBy("ord").select("term", "translation").write.options(escape='"', quoteAll="true", emptyValue="", nullValue="", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(at)
    return glossary_io.read_csv(spark, f"{at}/*.csv").select("term", "translation")


def index_npy(spark: SparkSession, d: str) -> DataFrame:
    """(pos, term, first): the vectors of full width written as a matrix with its list of terms, and zipped again."""
    at = shared_folder(spark, "index-npy").removeprefix("file://")
    glossary_io.write_npy(_index(spark, d).filter(F.size("embedding") == WIDTH), at + ".npy", at + ".json")
    return glossary_io.read_npy(spark, at + ".npy", at + ".json").select("pos", "term", F.col("embedding")[0].cast("double").alias("first"))


def cleaned_keywords(spark: SparkSession, d: str) -> DataFrame:
    """(row_idx, keywords): the parts of every id and blanks among them, cleaned."""
    parts = F.concat(F.split("id", "_"), F.array(F.lit(" x "), F.lit(""), F.lit("X")))
    return _rows(spark, d).filter("id is not null").select("row_idx", F.array_join(T.clean_keywords(parts), "|").alias("keywords"))


# -- exchanges ----------------------------------------------------------------


def exchanges(spark: SparkSession, d: str) -> DataFrame:
    """(source, translation, status, calls): every distinct source through the whole exchange with a model that repeats its input."""
    got = dialogue.translate_rows(S.dedup_plan(_rows(spark, d)).select("source"), "source", None, RepeatTranslator())
    return got.select("source", "translation", "status", "calls")


def result_feed(spark: SparkSession, d: str) -> DataFrame:
    """(row_idx, source, translation): results of all rows as a table that grows by whole batches."""
    at = shared_folder(spark, "result-feed")
    r = _rows(spark, d)
    done = dialogue.translate_rows(S.dedup_plan(r).select("source"), "source", None, RepeatTranslator())
    S.append_results(S.fan_out(r, done), at)
    return S.read_results(spark, at)


def retrieve_tiered(spark: SparkSession, d: str) -> DataFrame:
    """(kw_id, slot, term, tier, score): ranked terms for every glossary entry whose ord is divisible by 100."""
    base = retrieve.indexed_glossary(_glossary(spark, d), _index(spark, d), WIDTH)
    kws = base.filter("ord % 100 = 0 and term is not null").select(F.col("ord").alias("kw_id"), F.col("term").alias("keyword"), "embedding")
    return retrieve.tiered(kws, base, WIDTH).select("kw_id", "slot", "term", "tier", F.round("score", 6).alias("score"))


def retrieved_terms(spark: SparkSession, d: str) -> DataFrame:
    """(term, translation, n_keywords): the matched terms of all keywords, each once."""
    base = retrieve.indexed_glossary(_glossary(spark, d), _index(spark, d), WIDTH)
    kws = base.filter("ord % 100 = 0 and term is not null").select(F.col("ord").alias("kw_id"), F.col("term").alias("keyword"), "embedding")
    return retrieve.tiered(kws, base, WIDTH).groupBy("term", "translation").agg(F.count(F.lit(1)).alias("n_keywords"))


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    g = _glossary(spark, d)
    texts = S.dedup_plan(_rows(spark, d)).select(F.col("rep_row_idx").alias("key"), F.col("source").alias("text"))
    kw = retrieve.keywords(texts, "key", "text")
    hits = glossary_containment_top5(spark, d)
    matched = kw.join(hits, "keyword").select("key", "term", (F.col("kw_pos") * 10 + F.col("rank")).alias("first"))
    return retrieve.mentions(texts, matched, g)


def mention_priority(spark: SparkSession, d: str) -> DataFrame:
    """(key, term, mentioned, place): matched terms of every distinct source, those in the text first."""
    return _mentions(spark, d).select("key", "term", "mentioned", "place")


def glossary_block(spark: SparkSession, d: str) -> DataFrame:
    """(key, block): the glossary lines for every distinct source."""
    return retrieve.glossary_block(_mentions(spark, d))


def chat_messages(spark: SparkSession, d: str) -> DataFrame:
    """(key, n_messages, system_chars, user): messages for every distinct source."""
    texts = S.dedup_plan(_rows(spark, d)).select(F.col("rep_row_idx").alias("key"), F.col("source").alias("text"))
    m = texts.join(glossary_block(spark, d), "key", "left").withColumn("m", retrieve.messages(F.lit("Translate."), F.col("block"), F.col("text")))
    return m.select("key", F.size("m").alias("n_messages"), F.length(F.col("m")[0]["content"]).alias("system_chars"), F.col("m")[1]["content"].alias("user"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries of this module by name."""
    return {k: v for k, v in globals().items() if k in oracle.NAMES}


def oracle_sql() -> dict[str, str]:
    """Their SQL."""
    return oracle.sql()
