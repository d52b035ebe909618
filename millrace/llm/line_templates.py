"""Operator 2: line dedup by a tree of log templates.

A line's words (those with a digit become <*>) lead down a tree of fixed depth: the number of words, then the two leading words. In the leaf at its end the
line's variable fields are generalised: a word's support is the number of different lines of the leaf that have it in its place, and a word with at most half of the
support of the line's median word (the lower one) is a field. So any number of fields is found at once, and a line whose words are all as rare as each other has none. The
line with its fields as <*> is its template; a template counts only if at least half of its words are fixed and FIELD_LINES different lines share it, else the line is
its own template. A line that is mostly masked (less than half of its words without a digit) recurs by its exact words alone.

So each line has one template. A template that stands in two documents or more is dropped wherever it stands but for its first line, by (doc_id, line number): the first line
of a template is never dropped. As in every such tree, a line with a variable word (without a digit) among its two leading ones is in a leaf of its own.

Nulls: a null text has no lines; lines under a null doc_id are neither counted nor dropped. Lines without words stay. Repeated rows are one document; rows of one doc_id
with different texts are judged apart, but do not make a template recur. Very long texts and lines are taken whole. Empty table: no row. dedup() leaves out a document only
if no word of it is left. Other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WHITE, let, nested, remove_stored, stored

#: Different lines that show a template with fields: two that differ do not tell a field from an edit.
FIELD_LINES = 3
MASK = "<*>"


def _plain(text: Column) -> Column:
    return F.translate(text, WHITE.replace("\n", "").replace(" ", ""), "    ")


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, " "), "")


def _masked(text: Column) -> Column:
    return F.when(text.rlike("[0-9]"), F.regexp_replace(text, r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*", MASK)).otherwise(text)


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_id, line (from 0), leaf, a and b (96 bits for the words of the line) and general (half of the words have no digit) of each line with a word."""
    split = F.arrays_zip(F.split(_plain(_masked(F.col("text"))), "\n").alias("m"), F.split(_plain(F.col("text")), "\n").alias("r"))
    cut = docs.where("doc_id is not null").select("doc_id", F.hash("text").alias("text_id"), F.posexplode(split).alias("line", "x"))
    words = cut.select("doc_id", "text_id", "line", _words(F.col("x.m")).alias("w"), F.col("x.r").alias("r")).where("size(w) > 0")

    def told(w: Column) -> Column:
        general = 2 * F.size(F.array_remove(w, MASK)) >= F.size(w)
        key = lambda kind, x: F.struct(F.xxhash64(F.lit(kind), x).alias("a"), F.hash(F.lit(kind), x).alias("b"))
        leaf = F.xxhash64(F.size(w), F.get(w, F.lit(0)), F.get(w, F.lit(1)))
        return F.struct(leaf.alias("leaf"), F.when(general, key("masked", w)).otherwise(key("raw", _words(F.col("r")))).alias("k"), general.alias("general"))

    return words.select("doc_id", "text_id", "line", let(F.col("w"), told).alias("t")).select("doc_id", "text_id", "line", "t.leaf", "t.k.a", "t.k.b", "t.general")


def _extracted(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """a, b, leaf and words (hashes) of wanted lines (doc_id, text_id, line, a, b, leaf), read again from their texts."""
    asked = stored(wanted.groupBy(F.col("doc_id").alias("_d"), F.col("text_id").alias("_t")).agg(F.collect_list(F.struct("line", "a", "b", "leaf")).alias("asked")), "asked")
    met = docs.select("doc_id", "text", F.hash("text").alias("_h")).join(asked, (F.col("doc_id") == F.col("_d")) & (F.col("_h") == F.col("_t")))
    # the whole text is parted once; each asked line is taken from it
    own = let(F.split(_plain(_masked(F.col("text"))), "\n"), lambda x: F.transform("asked", lambda k: F.struct(k["a"].alias("a"), k["b"].alias("b"), k["leaf"].alias("leaf"), F.transform(_words(F.get(x, k["line"])), lambda y: F.xxhash64(y)).alias("w"))))
    return met.select(F.inline(own)).dropDuplicates(["a", "b"])


def templates(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """a, b, and ta, tb (the template) of the lines with fields. distinct: a, b, leaf, general and first of each different line."""
    shared = distinct.where("general").groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= FIELD_LINES)
    wanted = distinct.where("general").join(shared.select("leaf"), "leaf").select("first.doc_id", "first.text_id", "first.line", "a", "b", "leaf")
    own = stored(_extracted(docs, wanted), "words")
    tokens = own.select("a", "b", "leaf", F.posexplode("w").alias("at", "word"))
    support = stored(tokens.groupBy("leaf", "at", "word").agg(F.count("*").alias("s")).where("s > 1"), "support")
    met = tokens.join(support, ["leaf", "at", "word"], "left").groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("at", "word", F.coalesce("s", F.lit(1)).alias("s")))).alias("x"))
    masked = F.xxhash64(F.lit(MASK))

    def template(x: Column, bar: Column) -> Column:
        t = F.transform(x, lambda y: F.when(2 * y["s"] <= bar, masked).otherwise(y["word"]))
        return let(t, lambda t: F.struct(F.exists(x, lambda y: 2 * y["s"] <= bar).alias("fields"), (2 * F.size(F.array_remove(t, masked)) >= F.size(t)).alias("fixed"), F.xxhash64(F.lit("fields"), t).alias("ta"), F.hash(F.lit("fields"), t).alias("tb")))

    middle = lambda x: F.get(F.sort_array(F.transform(x, lambda y: y["s"])), F.floor((F.size(x) - 1) / 2).cast("int"))
    # exploded, so that the filter does not make the template a second time
    made = met.select("a", "b", F.explode(F.array(let(F.col("x"), lambda x: let(middle(x), lambda bar: template(x, bar))))).alias("t"))
    return made.where("t.fields and t.fixed").select("a", "b", "t.ta", "t.tb")


def dropped(docs: DataFrame) -> DataFrame:
    """doc_id, text_id and lines: the sorted numbers of the lines to drop, for documents that have such lines."""
    each = stored(lines(docs), "lines")
    place = F.struct("doc_id", "text_id", "line")
    distinct = stored(each.groupBy("a", "b").agg(F.min(place).alias("first"), F.max("doc_id").alias("last"), F.first("leaf").alias("leaf"), F.first("general").alias("general")), "distinct")
    of = stored(templates(docs, distinct), "templates")
    places = distinct.select("a", "b", "first", "last")
    shared = stored(places.join(of, ["a", "b"]).groupBy("ta", "tb").agg(F.min("first").alias("t_first"), F.max("last").alias("t_last"), F.count("*").alias("n")).where(F.col("n") >= FIELD_LINES), "shared")
    known = places.join(of.join(shared, ["ta", "tb"]), ["a", "b"], "left")
    again = stored(known.select("a", "b", F.coalesce("t_first", "first").alias("first"), F.coalesce("t_last", "last").alias("last")).where("first.doc_id <> last").select("a", "b", "first"), "again")
    gone = each.join(again, ["a", "b"]).where(place != F.col("first"))
    out = stored(gone.groupBy("doc_id", "text_id").agg(F.sort_array(F.collect_set("line")).alias("lines")), "dropped")
    remove_stored(each, distinct, of, shared, again)
    return out


def marked(docs: DataFrame) -> DataFrame:
    """docs with kept_text (null where no line goes), n_lines (with a word) and dropped_lines (null where no line goes)."""
    gone = dropped(docs.select("doc_id", "text")).withColumnsRenamed({"doc_id": "_doc_id", "text_id": "_text_id", "lines": "dropped_lines"})
    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    known = docs.withColumns({"n_lines": n.cast("long"), "_text_hash": F.hash("text")})
    df = known.join(gone, (F.col("doc_id") == F.col("_doc_id")) & (F.col("_text_hash") == F.col("_text_id")), "left").drop("_doc_id", "_text_id", "_text_hash")
    rest = let(F.split("text", "\n"), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("dropped_lines")), lambda i: F.get(x, i)), "\n"))
    return df.withColumn("kept_text", F.when(F.col("dropped_lines").isNotNull(), rest))


def dedup(docs: DataFrame) -> DataFrame:
    """The documents without recurring lines; documents of which no word is left go."""
    df = marked(nested(docs))
    kept = df.where(F.col("kept_text").isNull() | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.select(*[F.coalesce("kept_text", "text").alias("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])


#: The same by strings in place of hashes: line numbers dropped of each document.
ORACLE = rf"""
with lines as (
  select doc_id, unnest(range(len(l))) as line, unnest(l) as raw from (select doc_id, string_split(text, chr(10)) as l from documents where text is not null)
), words as (
  select doc_id, line, list_filter(string_split(regexp_replace(raw, '[\x09-\x0D]', ' ', 'g'), ' '), lambda x: x <> '') as r,
    list_filter(string_split(regexp_replace(regexp_replace(raw, '[\x09-\x0D]', ' ', 'g'), '[^ ]*[0-9][^ ]*', '<*>', 'g'), ' '), lambda x: x <> '') as w from lines
), inked as (
  select doc_id, line, w, len(w) as n, 2 * len(list_filter(w, lambda x: x <> '<*>')) >= len(w) as general, case when 2 * len(list_filter(w, lambda x: x <> '<*>')) >= len(w) then w else list_concat(['raw'], r) end as key
  from words where len(w) > 0
), different as (
  select general, key, n, min(struct_pack(d := doc_id, l := line)) as first, max(doc_id) as last from inked group by general, key, n
), tokens as (
  select key, n, unnest(range(n)) as place, unnest(key) as word, key[1] as one, key[2] as two from different where general
), supported as (
  select key, n, place, word, count(*) over (partition by n, one, two, place, word) as s from tokens
), barred as (
  select key, n, list_sort(list(s))[(n + 1) // 2] as bar from supported group by key, n
), generalised as (
  select key, n, list(case when 2 * s <= bar then '<*>' else word end order by place) as t, bool_or(2 * s <= bar) as fields from supported join barred using (key, n) group by key, n
), fielded as (
  select key, n, t from generalised where fields and 2 * len(list_filter(t, lambda x: x <> '<*>')) >= n
), shared as (
  select t, min(first) as first, max(last) as last from fielded join different using (key, n) where general group by t having count(*) >= {FIELD_LINES}
), known as (
  select d.general, d.key, coalesce(s.first, d.first) as first, coalesce(s.last, d.last) as last
  from different d left join fielded f on d.general and d.key = f.key left join shared s on f.t = s.t
), gone as (
  select doc_id, line from inked join known using (general, key) where first.d <> last and struct_pack(d := doc_id, l := line) <> first
), per_doc as (
  select doc_id, count(*) as n_dropped, string_agg(line::varchar, ',' order by line) as dropped_lines from gone group by doc_id
)
select d.doc_id, coalesce(i.n_lines, 0)::bigint as n_lines, coalesce(p.n_dropped, 0)::bigint as n_dropped, coalesce(p.dropped_lines, '') as dropped_lines
from documents d left join (select doc_id, count(*) as n_lines from inked group by doc_id) i using (doc_id) left join per_doc p using (doc_id)
"""
