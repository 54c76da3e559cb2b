"""Full-text search over the archive's texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garner.functions.text import normalised, occurrences
from garner.operators.fulltext import CLOSE, OPEN, bm25, fragments, marked, matches, phrase_hits, postings, runs, terms, tokens, word_line
from garner.sources.tables import table


def search_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Posts with every term of a query; terms with punctuation are phrases."""
    t = table(spark, folder, "tweets", "id", "text").distinct()
    return t.where(matches([F.col("text")], terms("harbour no-rush"), any_of=True)).select("id")


def search_mails(spark: SparkSession, folder: str) -> DataFrame:
    """Mails with every word of a query in subject or body."""
    m = table(spark, folder, "messages", "id", "subject", "body").groupBy("id").agg(F.min("subject").alias("subject"), F.min("body").alias("body"))
    return m.where(matches([F.col("subject"), F.col("body")], tokens("kayak rack"))).select("id")


def search_titles_only(spark: SparkSession, folder: str) -> DataFrame:
    """Events found by words of their summary or place alone: other columns are indexed but not searched."""
    e = table(spark, folder, "calendar_events", "event_uid", "summary", "location_title", "description").groupBy("event_uid")
    e = e.agg(F.min("summary").alias("summary"), F.min("location_title").alias("location_title"))
    return e.where(matches([F.col("summary"), F.col("location_title")], terms("clinic"))).select("event_uid")


def ranked_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with both words of a query and their rank."""
    d = table(spark, folder, "documents", "doc_id", "text")
    return bm25(d, "doc_id", "text", tokens("harbour parcel")).select("doc_id", F.round("score", 6).alias("score"))


def indexed_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a phrase, and how often, through the inverted index."""
    d = table(spark, folder, "documents", "doc_id", "text")
    return phrase_hits(postings(d, "doc_id", "text"), "doc_id", ["the", "choir", "list"])


def word_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and places of every word, from the inverted index."""
    index = postings(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")
    return index.groupBy("word").agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("places"))


def marked_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Posts that hold a word: the number of marked runs and the length of the text outside them."""
    t = table(spark, folder, "tweets", "id", "text").distinct().where(F.contains(word_line(F.col("text")), F.lit(" weather ")))
    r = t.select("id", runs(marked(F.col("text"), ["weather"])).alias("r"))
    return r.select("id", F.size(F.filter("r", lambda x: x["matched"])).alias("marks"), F.length(F.array_join(F.transform("r", lambda x: x["text"]), "")).alias("size"))


def unmarked_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Marked text is the text itself once the marks are gone."""
    t = table(spark, folder, "tweets", "id", "text").distinct().where(F.lower("text").contains("weather"))
    plain = F.translate(marked(F.col("text"), ["weather"]), OPEN + CLOSE, "")
    return t.select("id", (plain == F.col("text")).alias("same"))


def mail_fragments(spark: SparkSession, folder: str) -> DataFrame:
    """Fragment of at most 120 characters of each mail around the first word of the query."""
    m = table(spark, folder, "messages", "id", "body").where("body is not null").groupBy("id").agg(F.min("body").alias("body"))
    return fragments(m, "id", "body", "harbour router", 120)


def people_by_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """People of whom some field has, for every word of the query, a word that begins with it."""
    p = table(spark, folder, "people", "id", "name", "sort_name", "relationship_context").distinct()
    v = table(spark, folder, "contact_values", "person_id", "value").where("value is not null").distinct()
    fields = p.select("id", F.explode(F.array("name", "sort_name", "relationship_context")).alias("field")).unionByName(v.select(F.col("person_id").alias("id"), F.col("value").alias("field")))
    words = fields.select("id", F.explode(F.split(F.trim(word_line(F.col("field"))), " ")).alias("word"))
    begins = [F.max(F.col("word").startswith(q)).alias(q) for q in ("ja", "l")]
    return words.groupBy("id").agg(*begins).where("ja and l").join(p.select("id").distinct(), "id", "left_semi").select("id")


def note_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Notes by how often the query occurs in their latest texts: 100 for the query itself."""
    v = table(spark, folder, "note_versions", "note_id", "text").where("text is not null").distinct()
    scored = v.select("note_id", occurrences(F.col("text"), "garden").alias("score")).groupBy("note_id").agg(F.max("score").alias("score"))
    return scored.where("score > 0")


def folded_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per name folded to lower case with single blanks."""
    return table(spark, folder, "handles", "display_name").where("display_name is not null").groupBy(normalised(F.col("display_name")).alias("name")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        search_posts, search_mails, search_titles_only, ranked_documents, indexed_phrases, word_frequencies, marked_posts, unmarked_posts, mail_fragments, people_by_prefix, note_scores, folded_keys,
    )
}

_MARKED, _PLAIN = "àáâãäåāăąçćĉċčďđèéêëēĕėęěĝğġģĥħìíîïĩīĭįıĵķĺļľŀłñńņňòóôõöøōŏőŕŗřśŝşšţťŧùúûüũūŭůűųŵýÿŷźżž", "aaaaaaaaacccccddeeeeeeeeegggghhiiiiiiiiijklllllnnnnooooooooorrrsssstttuuuuuuuuuuwyyyzzz"


def _line(c: str) -> str:
    return f"(' ' || trim(regexp_replace(translate(lower(coalesce({c}, '')), '{_MARKED}', '{_PLAIN}'), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', ' ', 'g')) || ' ')"


SQL = {
    "search_posts": f"select distinct id from tweets where contains({_line('text')}, ' harbour ') or contains({_line('text')}, ' no rush ')",
    "search_mails": f"""
with m as (select id, {_line('min(subject)')} as s, {_line('min(body)')} as b from messages group by id)
select id from m where (contains(s, ' kayak ') or contains(b, ' kayak ')) and (contains(s, ' rack ') or contains(b, ' rack '))""",
    "search_titles_only": f"""
with e as (select event_uid, {_line('min(summary)')} as s, {_line('min(location_title)')} as l from calendar_events group by 1)
select event_uid from e where contains(s, ' clinic ') or contains(l, ' clinic ')""",
    "ranked_documents": f"""
with d as (select doc_id, {_line('text')} as t from documents),
f as (select doc_id, cast((length(t) - length(replace(t, ' harbour ', ' '))) / 8 as integer) as f0, cast((length(t) - length(replace(t, ' parcel ', ' '))) / 7 as integer) as f1,
             len(list_filter(string_split(t, ' '), lambda w: w <> '')) as size from d),
s as (select count(*) as n, avg(size) as mean, count(*) filter (f0 > 0) as d0, count(*) filter (f1 > 0) as d1 from f)
select doc_id, round(greatest(ln((n - d0 + 0.5) / (d0 + 0.5)), 1e-6) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * size / mean))
                   + greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * size / mean)), 6) as score
from f, s where f0 > 0 and f1 > 0""",
    "indexed_phrases": f"""
with w as (select doc_id, string_split(trim({_line('text')}), ' ') as l from documents where text is not null),
p as (select doc_id, len(list_filter(range(1, len(l) - 1), lambda i: l[i] = 'the' and l[i + 1] = 'choir' and l[i + 2] = 'list')) as hits from w)
select doc_id, hits from p where hits > 0""",
    "word_frequencies": f"""
select word, count(distinct doc_id) as documents, count(*) as places
from (select doc_id, unnest(string_split(trim({_line('text')}), ' ')) as word from documents where text is not null) where word <> '' group by 1""",
    "unmarked_posts": "select distinct id, true as same from tweets where contains(lower(text), 'weather')",
    "people_by_prefix": f"""
with f as (select id, concat_ws(' ', name, sort_name, relationship_context) as t from people union all select person_id, value from contact_values where person_id in (select id from people)),
p as (select id, string_split(trim({_line("string_agg(t, ' ')")}), ' ') as w from f group by id)
select id from p where len(list_filter(w, lambda x: starts_with(x, 'ja'))) > 0 and len(list_filter(w, lambda x: starts_with(x, 'l'))) > 0""",
    "note_scores": """
select note_id, max(s) as score from (
  select note_id, case when trim(lower(text)) = 'garden' then 100 else cast((length(lower(text)) - length(replace(lower(text), 'garden', ''))) / 6 as integer) end as s
  from note_versions where text is not null) group by 1 having max(s) > 0""",
    "folded_keys": "select lower(trim(regexp_replace(display_name, '\\s+', ' ', 'g'))) as name, count(*) as n from handles where display_name is not null group by 1",
}
