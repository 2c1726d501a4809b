"""The query catalogue: each query with the SQL that gives its rows, where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import alignment, text
from quire.operators import documents, graphs, rows, tables, witnesses
from quire.plans import scripts
from quire.sources import corpora

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(scripts.QUERIES)
ORACLE_SQL: dict[str, str] = dict(scripts.ORACLE_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and texts of the documents, over all cores."""
    return rows.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


LAYOUT = r"[ \t\n\r]+"


@query(r"""
WITH lines AS (
  SELECT doc_id, n, trim(regexp_replace(l, '[ \t\n\r]+', ' ', 'g'), ' ') AS l
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)),
ids AS (
  SELECT doc_id, sha256(coalesce(string_agg(l, chr(10) ORDER BY n) FILTER (l <> ''), '')) AS content_id FROM lines GROUP BY doc_id)
SELECT content_id, count(*) AS n_documents, min(doc_id) AS first_doc FROM ids GROUP BY content_id HAVING count(*) > 1""")
def duplicate_works(spark, sf_dir):
    docs = texts(spark, sf_dir)
    lines = F.transform(F.split("text", "\n"), lambda x: F.btrim(F.regexp_replace(x, LAYOUT, " ")))
    body = F.array_join(F.filter(lines, lambda x: x != ""), "\n")
    return docs.select("doc_id", F.sha2(body, 256).alias("content_id")).groupBy("content_id").agg(F.count(F.lit(1)).alias("n_documents"), F.min("doc_id").alias("first_doc")).where("n_documents > 1")


# Text operators. Java writes code points as \x{85}, the SQL engine's RE2 likewise.
_WS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Characters with the next one that shows: a cut stands before that one, if white space lies between (for words, a
#: space), a mark ends what is before, and something shows before the mark.
_CHARS = rf"""WITH c AS (SELECT doc_id, unnest(x) AS ch, generate_subscripts(x, 1) AS i, len(x) AS n FROM (SELECT doc_id, string_split(text, '') AS x FROM documents)),
s AS (SELECT *, sum(CASE WHEN ch = ' ' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS spaces FROM c),
v AS (SELECT *, lag(i) OVER o AS j, lag(ch) OVER o AS mark, lag(spaces) OVER o AS had, row_number() OVER o AS k FROM s WHERE NOT regexp_matches(ch, '{_WS}') WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
w AS (SELECT doc_id, 0 AS i, 0 AS j, 0 AS k, '' AS mark, 0 AS had, 0 AS spaces, 0 AS n FROM documents UNION ALL SELECT doc_id, i, j, k, mark, had, spaces, n FROM v)"""


def _is_cut(marks: str) -> str:
    return "k > 1 AND spaces > had" if marks == alignment.WORD else f"k > 2 AND i > j + 1 AND contains('{marks}', mark)"


@query(r"""SELECT doc_id, CAST(n - 1 AS INTEGER) AS n, l AS line FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
WHERE regexp_matches(l, '[^ \t\r]')""")
def line_scan(spark, sf_dir):
    found = texts(spark, sf_dir).select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("n", "line"))
    return found.where(F.col("line").rlike(r"[^ \t\r]"))


@query(r"""SELECT doc_id, CAST(k AS INTEGER) AS stanza, CAST(len(string_split(s, chr(10))) AS INTEGER) AS n_lines, md5(s) AS stanza_md5 FROM (
  SELECT doc_id, unnest(x) AS s, generate_subscripts(x, 1) - 1 AS k FROM (
    SELECT doc_id, list_filter(regexp_split_to_array(trim(replace(text, '. ', '.' || chr(10) || chr(10)), chr(10)), '\n([ \t\r]*\n)+'), lambda s: s <> '') AS x FROM documents))""")
def stanza_islands(spark, sf_dir):
    """Sentences set apart by blank lines stand in for stanzas; blank lines break them."""
    body = F.btrim(F.replace(F.col("text"), F.lit(". "), F.lit(".\n\n")), F.lit("\n"))
    stanzas = F.filter(F.split(body, r"\n(?:[ \t\r]*\n)+"), lambda s: s != "")
    found = texts(spark, sf_dir).select("doc_id", F.posexplode(stanzas).alias("stanza", "s"))
    return found.select("doc_id", "stanza", F.size(F.split("s", "\n")).alias("n_lines"), F.md5("s").alias("stanza_md5"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'), ' ')) AS layout_md5 FROM documents""")
def layout_normalize(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.md5(text.collapse_layout(F.col("text"))).alias("layout_md5"))


@query(r"""
WITH lines AS (
  SELECT doc_id, n, trim(regexp_replace(l, '[ \t\n\r]+', ' ', 'g'), ' ') AS l
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents))
SELECT doc_id, sha256(coalesce(string_agg(l, chr(10) ORDER BY n) FILTER (l <> ''), '')) AS content_id FROM lines GROUP BY doc_id""")
def content_id(spark, sf_dir):
    body = F.array_join(F.filter(F.transform(F.split("text", "\n"), text.collapse_layout), lambda x: x != ""), "\n")
    return texts(spark, sf_dir).select("doc_id", F.sha2(body, 256).alias("content_id"))


@query(rf"""SELECT word, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (
  SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '{_WS}+'), lambda w: w <> '')) AS word FROM documents) GROUP BY word""")
def word_table(spark, sf_dir):
    """A row's words are sorted in place, so that each word's first occurrence is marked before the one exchange."""
    found = texts(spark, sf_dir).select(F.explode(_firsts(text.words(F.col("text")))).alias("x"))
    return found.groupBy(F.col("x.v").alias("word")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x.first").cast("long")).alias("n_docs"))


def _firsts(values):
    """Sorted values, each with whether it is the first of its kind.

    The values are set beside themselves by one place: a lambda that looked into them would sort them once an element.
    """
    held = F.array_sort(values)
    before = F.slice(F.concat(F.array(F.lit(None).cast("string")), held), F.lit(1), F.size(held))
    return F.zip_with(held, before, lambda v, b: F.struct(v.alias("v"), (~v.eqNullSafe(b)).alias("first")))


@query("""SELECT doc_id, CAST(sum(length(l)) AS BIGINT) AS mass FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY doc_id""")
def char_mass(spark, sf_dir):
    total = F.aggregate(F.split("text", "\n"), F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return texts(spark, sf_dir).select("doc_id", total.alias("mass"))


@query(f"""{_CHARS} SELECT doc_id, CAST(count(*) FILTER ({_is_cut(alignment.SENTENCE)}) AS INTEGER) AS n_sentence, CAST(count(*) FILTER ({_is_cut(alignment.CLAUSE)}) AS INTEGER) AS n_clause,
  CAST(count(*) FILTER ({_is_cut(alignment.WORD)}) AS INTEGER) AS n_word FROM w GROUP BY doc_id""")
def tier_counts(spark, sf_dir):
    n = lambda marks, name: text.cut_count(F.col("text"), marks).alias(name)
    return table(spark, sf_dir, "documents").select("doc_id", n(alignment.SENTENCE, "n_sentence"), n(alignment.CLAUSE, "n_clause"), n(alignment.WORD, "n_word"))


@query(f"""{_CHARS} SELECT doc_id, CAST(min({{'off': abs(i - 1 - n // 2), 'at': i - 1}}) FILTER ({_is_cut(alignment.SENTENCE)}).at AS INTEGER) AS cut FROM w GROUP BY doc_id""")
def midpoint_cut(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.nearest_cut(F.col("text"), alignment.SENTENCE).alias("cut"))


@query(r"""SELECT doc_id, md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped_md5 FROM documents""")
def escape_once(spark, sf_dir):
    marks = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;"}
    return texts(spark, sf_dir).select("doc_id", F.md5(text.escape_once(F.col("text"), marks)).alias("escaped_md5"))


@query(r"""SELECT doc_id, md5('> ' || replace(replace(regexp_replace(text, '\n([^\n])', chr(10) || '> \1', 'g'), chr(10) || chr(10), chr(10) || '>' || chr(10)), chr(10) || chr(10), chr(10) || '>' || chr(10))) AS quoted_md5 FROM documents""")
def hanging_prefix(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.md5(F.concat(F.lit("> "), text.hanging_prefix(F.col("text"), "> "))).alias("quoted_md5"))


@query("""SELECT doc_id, '<p' || CASE WHEN lang <> '' THEN ' lang="' || lang || '"' ELSE '' END || CASE WHEN source = 'src0' THEN ' class="' || source || '"' ELSE '' END || '>' AS opening FROM documents""")
def conditional_fill(spark, sf_dir):
    """A section of a template is written only if its slots are filled."""
    part = lambda name, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f' {name}="'), value, F.lit('"'))).otherwise("")
    kind = F.when(F.col("source") == "src0", F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("<p"), part("lang", F.col("lang")), part("class", kind), F.lit(">")).alias("opening"))


# Anchors, ordinals and references.


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS anchor FROM events""")
def anchor_asof(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    value = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return rows.anchor_asof(events, ["user_id"], ["ts", "event_id"], value).select("event_id", "anchor")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def coord_unique(spark, sf_dir):
    return rows.repeated(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.coord, b.coord) AS coord, a.n AS n_user, b.n AS n_assistant
FROM (SELECT conv_id, turn // 2 AS coord, sum(length(text))::BIGINT AS n FROM conversations WHERE role = 'user' GROUP BY ALL) a
FULL JOIN (SELECT conv_id, turn // 2 AS coord, sum(length(text))::BIGINT AS n FROM conversations WHERE role = 'assistant' GROUP BY ALL) b
ON a.conv_id = b.conv_id AND a.coord = b.coord""")
def weave(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("coord", F.floor(F.col("turn") / 2))
    side = lambda role, name: turns.where(F.col("role") == role).groupBy("conv_id", "coord").agg(F.sum(F.length("text")).alias(name))
    return rows.weave(side("user", "n_user"), side("assistant", "n_assistant"), ["conv_id", "coord"])


@query("""SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n_inversions FROM (SELECT * FROM lineitem) a JOIN (SELECT l_orderkey AS k, l_linenumber AS n2, l_partkey AS p2 FROM lineitem) b
ON a.l_orderkey = b.k AND a.l_linenumber < b.n2 AND a.l_partkey > b.p2 GROUP BY l_orderkey""")
def order_inversions(spark, sf_dir):
    return rows.inversions(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", "l_partkey")


@query(rf"""SELECT conv_id, turn, CAST(k AS INTEGER) AS nth, w AS word FROM (SELECT conv_id, turn, unnest(x) AS w, generate_subscripts(x, 1) AS k FROM (
  SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '{_WS}+'), lambda w: w <> '') AS x FROM conversations)) WHERE k % 10 = 0""")
def apparatus_positions(spark, sf_dir):
    """Every tenth word of a slice, where a note would be placed."""
    found = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(text.words(F.col("text"))).alias("k", "word"))
    return found.where((F.col("k") + 1) % 10 == 0).select("conv_id", "turn", (F.col("k") + 1).alias("nth"), "word")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def ref_undefined(spark, sf_dir):
    return rows.undefined(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT l_orderkey, l_linenumber, l_linestatus, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus <> o_orderstatus")
def ref_mismatch(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return rows.mismatched(lines, orders, ["l_orderkey"], "l_linestatus", "o_orderstatus")


@query("""SELECT o_custkey, o_orderkey, 'o' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS new_name FROM orders
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)""")
def anchor_renumber(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    used = used.distinct()
    kept = orders.join(used, "o_orderkey", "left_semi")
    return rows.renumber(kept, kept, ["o_custkey"], "o_orderkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "new_name")


@query("""WITH s AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
i AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM s)
SELECT event_id, CAST(island AS BIGINT) AS island, CAST(row_number() OVER (PARTITION BY user_id, island ORDER BY event_id) AS INTEGER) AS ordinal FROM i""")
def ordinal_runs(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return rows.ordinals(events, ["user_id"], ["event_id"], ["event_type"], F.lit(True)).select("event_id", "island", "ordinal")


@query("""WITH o AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS expected FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(expected AS INTEGER) AS expected FROM o WHERE expected <> l_linenumber""")
def ordinal_errors(spark, sf_dir):
    """Explicit ordinals that are not the next of their run. Ties hold equal values, so their order is free."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    found = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).alias("expected"))
    return found.where("expected <> l_linenumber")


_SLUG = r"array_to_string(list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''), '-')"


@query(f"SELECT c_custkey, {_SLUG.format('c_name')} AS anchor FROM customer")
def auto_anchor(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.slug(F.col("c_name")).alias("anchor"))


@query(f"""SELECT p_partkey, s || CASE WHEN count(*) OVER (PARTITION BY s) > 1 THEN '-' || row_number() OVER (PARTITION BY s ORDER BY p_partkey) ELSE '' END AS anchor
FROM (SELECT p_partkey, {_SLUG.format('p_name')} AS s FROM part)""")
def homographs(spark, sf_dir):
    """Heads spelled alike are told apart by their ordinal."""
    slugs = table(spark, sf_dir, "part").select("p_partkey", text.slug(F.col("p_name")).alias("s"))
    w = Window.partitionBy("s")
    number = F.when(F.count(F.lit(1)).over(w) > 1, F.concat(F.lit("-"), F.row_number().over(w.orderBy("p_partkey")))).otherwise("")
    return slugs.select("p_partkey", F.concat("s", number).alias("anchor"))


_TERMS = [("urgent", "1-urgent"), ("high", "2-high"), ("medium", "3-medium"), ("low", "5-low"), ("English", "en"), ("French", "fr")]
_TERMS_SQL = "(VALUES " + ", ".join(f"('{t}', '{a}')" for t, a in _TERMS) + ") AS v(term, alias)"


@query(f"SELECT o_orderkey, coalesce(term, o_orderpriority) AS canonical FROM orders LEFT JOIN {_TERMS_SQL} ON lower(o_orderpriority) = alias")
def vocab_canonical(spark, sf_dir):
    vocabulary = spark.createDataFrame(_TERMS, "term string, alias string")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return rows.canonical_terms(orders, vocabulary, "o_orderpriority").select("o_orderkey", "canonical")


@query(f"SELECT doc_id, coalesce(term, lang) AS canonical FROM documents LEFT JOIN {_TERMS_SQL} ON lower(lang) = alias")
def vocab_languages(spark, sf_dir):
    vocabulary = spark.createDataFrame(_TERMS, "term string, alias string")
    return rows.canonical_terms(table(spark, sf_dir, "documents").select("doc_id", "lang"), vocabulary, "lang").select("doc_id", "canonical")


# Tables, media, addresses and pages.

_ROW = "'|' || n_nationkey || ' | ' || n_name || ' \\| x | ' || n_regionkey || '|'"


@query(f"""SELECT n_nationkey, CAST(k - 1 AS INTEGER) AS cell, trim(replace(c, chr(1), '|')) AS content FROM (SELECT n_nationkey, unnest(x) AS c, generate_subscripts(x, 1) AS k FROM (
  SELECT n_nationkey, string_split(trim(replace({_ROW}, '\\|', chr(1)), '|'), '|') AS x FROM nation))""")
def shorthand_cells(spark, sf_dir):
    """Cells of a pipe row; an escaped separator is content."""
    row = F.concat(F.lit("|"), "n_nationkey", F.lit(" | "), "n_name", F.lit(" \\| x | "), "n_regionkey", F.lit("|"))
    found = table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(tables.split_cells(row)).alias("cell", "content"))
    return found


@query("""SELECT n_regionkey, k AS cell, coalesce(n_name, '') AS content FROM (SELECT n_regionkey, unnest(range(m)) AS k FROM (SELECT n_regionkey, count(*) AS c FROM nation GROUP BY 1), (SELECT max(c) + 1 AS m FROM (SELECT count(*) AS c FROM nation GROUP BY n_regionkey)))
LEFT JOIN (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k FROM nation) USING (n_regionkey, k)""")
def pad_rows(spark, sf_dir):
    """Short rows get empty cells up to the width of the table (here one more than its longest row)."""
    by = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("cells"))
    width = by.agg(F.max(F.size("cells")).alias("m"))
    padded = tables.pad(F.col("cells"), F.col("m") + 1)
    out = by.join(F.broadcast(width)).select("n_regionkey", F.posexplode(padded).alias("cell", "content"))
    return out.select("n_regionkey", F.col("cell").cast("long").alias("cell"), "content")


@query(r"""SELECT page_id, 'm' || row_number() OVER (PARTITION BY h ORDER BY page_id) || '.' || CASE WHEN e = '' THEN 'html' ELSE e END AS name, sha256(html) AS sha256 FROM (
  SELECT page_id, html, regexp_extract(url, '^https?://([^/?#]+)', 1) AS h, lower(regexp_extract(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '\.([A-Za-z0-9]+)$', 1)) AS e FROM pages)""")
def media_names(spark, sf_dir):
    """Bundled files are named in order within their document (here the host)."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("sha256"), F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), text.url_extension(F.col("url")).alias("e"))
    number = F.row_number().over(Window.partitionBy("host").orderBy("page_id"))
    return pages.select("page_id", F.concat(F.lit("m"), number, F.lit("."), F.when(F.col("e") == "", "html").otherwise(F.col("e"))).alias("name"), "sha256")


@query(r"""SELECT page_id, lower(regexp_extract(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '\.([A-Za-z0-9]+)$', 1)) AS extension FROM pages""")
def extension_infer(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.url_extension(F.col("url")).alias("extension"))


_LINKS_SQL = r"""SELECT page_id, url, generate_subscripts(x, 1) - 1 AS n, unnest(x) AS href FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS x FROM pages)"""


@query(rf"""SELECT page_id, CAST(n AS INTEGER) AS n, href, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN href[1] = '/' THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || href ELSE
  CASE WHEN f[-1] = '/' THEN f ELSE f || '/' END || href END AS target FROM (SELECT *, regexp_extract(url, '^(https?://[^/?#]+(?:/[^?#]*/|/)?)', 1) AS f FROM ({_LINKS_SQL}))""")
def url_resolve(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("n", "href"))
    return found.select("page_id", "n", "href", text.resolve_url(F.col("url"), F.col("href")).alias("target"))


@query(r"""SELECT tag, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[ >]', 1)) AS tag FROM pages) GROUP BY tag""")
def tag_stats(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select(F.explode(_firsts(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)[ >]"), 1))).alias("x"))
    return found.groupBy(F.col("x.v").alias("tag")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x.first").cast("long")).alias("n_pages"))


@query(r"""SELECT page_id, CAST(n - 1 AS INTEGER) AS n, h[3:3]::INTEGER AS level, regexp_replace(h[5:-6], '<[^>]*>', '', 'g') AS heading FROM (
  SELECT page_id, unnest(x) AS h, generate_subscripts(x, 1) AS n FROM (SELECT page_id, regexp_extract_all(html, '<h[1-6]>.*?</h[1-6]>') AS x FROM pages))""")
def headings(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<h[1-6]>.*?</h[1-6]>"), 0)).alias("n", "h"))
    inner = F.regexp_replace(F.expr("substring(h, 5, length(h) - 9)"), "<[^>]*>", "")
    return found.select("page_id", "n", F.substring("h", 3, 1).cast("int").alias("level"), inner.alias("heading"))


@query(_LINKS_SQL.replace("url, generate", "CAST(generate").replace("- 1 AS n", "- 1 AS INTEGER) AS n").replace("page_id, url, regexp", "page_id, regexp"))
def links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("n", "href"))


@query(r"""SELECT page_id, md5(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&nbsp;', chr(160)), '&amp;', '&')) AS decoded_md5 FROM pages""")
def entity_decode(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.decode_entities(F.col("html"))).alias("decoded_md5"))


@query(r"""WITH h AS (SELECT page_id, unnest(x) AS h, generate_subscripts(x, 1) AS n FROM (SELECT page_id, regexp_extract_all(html, '<h[1-6]>.*?</h[1-6]>|<p>') AS x FROM pages)),
heads AS (SELECT page_id, n, h[3:3]::INTEGER AS level, lead(n) OVER (PARTITION BY page_id ORDER BY n) AS nxt, (SELECT max(n) FROM h b WHERE b.page_id = h.page_id) AS last FROM h WHERE h <> '<p>')
SELECT page_id, CAST(n AS INTEGER) AS start, CAST(coalesce(nxt - 1, last) AS INTEGER) AS stop, level FROM heads""")
def outline(spark, sf_dir):
    """Headings with the span of blocks up to the next heading."""
    blocks = F.regexp_extract_all("html", F.lit("<h[1-6]>.*?</h[1-6]>|<p>"), 0)
    found = table(spark, sf_dir, "pages").select("page_id", F.size(blocks).alias("last"), F.posexplode(blocks).alias("n", "h")).where("h <> '<p>'")
    after = F.lead("n").over(Window.partitionBy("page_id").orderBy("n"))
    return found.select("page_id", (F.col("n") + 1).alias("start"), F.coalesce(after, F.col("last")).alias("stop"), F.substring("h", 3, 1).cast("int").alias("level"))


@query("SELECT source, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source")
def unresolved_labels(spark, sf_dir):
    found = rows.undefined(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id"), ["doc_id"])
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT conv_id, md5(string_agg('@' || role || chr(10) || text || chr(10) || role || '@', chr(10) ORDER BY turn)) AS body_md5 FROM conversations GROUP BY conv_id""")
def serialize_events(spark, sf_dir):
    """Opening and closing events put in order and joined per document."""
    part = F.concat(F.lit("@"), "role", F.lit("\n"), "text", F.lit("\n"), "role", F.lit("@"))
    by = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))).alias("xs"))
    return by.select("conv_id", F.md5(F.array_join(F.transform("xs", lambda x: x["part"]), "\n")).alias("body_md5"))


_NAMES = [("1-URGENT", "fr", "urgent"), ("2-HIGH", "fr", "haut"), ("1-URGENT", None, "urgency"), ("3-MEDIUM", None, "medium")]
_NAMES_SQL = "(VALUES " + ", ".join(f"('{s}', {'NULL' if g is None else repr(g)}, '{n}')" for s, g, n in _NAMES) + ") AS g(symbol, language, name)"


@query(f"""SELECT o_orderkey, '{{' || coalesce(a.name, b.name, o_orderpriority) || '}}' AS spelled FROM orders
LEFT JOIN (SELECT * FROM {_NAMES_SQL} WHERE language = 'fr') a ON o_orderpriority = a.symbol LEFT JOIN (SELECT * FROM {_NAMES_SQL} WHERE language IS NULL) b ON o_orderpriority = b.symbol""")
def respell(spark, sf_dir):
    """Symbols spelled out: the language's name, else the general one, else the symbol."""
    names = spark.createDataFrame(_NAMES, "symbol string, language string, name string")
    local = rows.small(names.where("language = 'fr'").select(F.col("symbol").alias("o_orderpriority"), F.col("name").alias("a")))
    general = rows.small(names.where("language IS NULL").select(F.col("symbol").alias("o_orderpriority"), F.col("name").alias("b")))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").join(local, "o_orderpriority", "left").join(general, "o_orderpriority", "left")
    return orders.select("o_orderkey", F.concat(F.lit("{"), F.coalesce("a", "b", "o_orderpriority"), F.lit("}")).alias("spelled"))


_RULES = [("r0", []), ("r1", ["en"]), ("r2", ["en", "good"]), ("r3", ["fr"]), ("r4", ["good"]), ("r5", ["toxic"])]
_RULES_SQL = "(VALUES " + ", ".join(f"('{r}', {c}::VARCHAR[])" for r, c in _RULES) + ") AS r(rule, classes)"


@query(f"""WITH nodes AS (SELECT doc_id AS node, [lang] || CASE WHEN quality = 1 THEN ['good'] ELSE [] END || CASE WHEN toxic = 1 THEN ['toxic'] ELSE [] END AS cs FROM documents JOIN labels USING (doc_id)),
fits AS (SELECT node, rule, len(classes) AS n FROM nodes, {_RULES_SQL} WHERE list_has_all(cs, classes)),
best AS (SELECT node, max(n) AS n FROM fits GROUP BY node)
SELECT node, max(rule) AS rule, count(*) > 1 AS tied FROM fits JOIN best USING (node, n) GROUP BY node""")
def rule_specificity(spark, sf_dir):
    classes = F.concat(F.array("lang"), F.when(F.col("quality") == 1, F.array(F.lit("good"))).otherwise(F.array().cast("array<string>")), F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(F.array().cast("array<string>")))
    nodes = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("doc_id").alias("node"), classes.alias("node_classes"), F.lit("doc").alias("kind"))
    rules = spark.createDataFrame([("doc", r, c) for r, c in _RULES], "kind string, rule string, classes array<string>")
    return rows.best_rules(nodes, rules, "kind")


# Mappings between schemas.

_MAP = [("view", "seen"), ("click", "pressed"), ("purchase", "bought")]
_MAP_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _MAP) + ") AS m(source, target)"


@query(f"SELECT event_id, coalesce(target, event_type) AS symbol FROM events LEFT JOIN {_MAP_SQL} ON event_type = source")
def morph_rename(spark, sf_dir):
    rules = rows.small(spark.createDataFrame(_MAP, "event_type string, target string"))
    return table(spark, sf_dir, "events").select("event_id", "event_type").join(rules, "event_type", "left").select("event_id", F.coalesce("target", "event_type").alias("symbol"))


@query("SELECT event_id, user_id FROM events WHERE event_type NOT IN ('error', 'signup')")
def morph_drop(spark, sf_dir):
    drop = rows.small(spark.createDataFrame([("error",), ("signup",)], "event_type string"))
    return rows.undefined(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), drop, ["event_type"]).select("event_id", "user_id")


@query("""SELECT event_id, last_value(CASE WHEN event_type <> 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent FROM events QUALIFY event_type <> 'click'""")
def morph_dissolve(spark, sf_dir):
    """A dissolved row passes what it held to the nearest row before it that stays."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type").where("event_type <> 'click'")
    return events.select("event_id", F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id")).alias("parent"))


@query("""SELECT user_id, region, count(*) AS n, min(event_id) AS first_event FROM (
  SELECT *, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS region FROM events) GROUP BY ALL""")
def morph_group(spark, sf_dir):
    """A trigger opens a region over what follows it."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    found = rows.regions(events, ["user_id"], ["event_id"], F.col("event_type") == "signup")
    return found.groupBy("user_id", "region").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query(f"SELECT DISTINCT event_type AS symbol FROM events WHERE event_type NOT IN (SELECT source FROM {_MAP_SQL})")
def morph_total(spark, sf_dir):
    """Symbols that a mapping has no rule for: none if it is total."""
    rules = rows.small(spark.createDataFrame(_MAP, "symbol string, target string"))
    return rows.undefined(table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol")).distinct(), rules, ["symbol"])


_MANY = [*_MAP, ("error", "seen"), ("signup", "signup")]
_MANY_SQL = _MAP_SQL.replace(") AS m", ", ('error', 'seen'), ('signup', 'signup')) AS m")


@query(f"SELECT target, count(*) AS n FROM {_MANY_SQL} GROUP BY target HAVING count(*) > 1")
def morph_bijective(spark, sf_dir):
    """Targets of several symbols: none if the mapping can be reversed."""
    return rows.repeated(spark.createDataFrame(_MANY, "source string, target string"), ["target"])


@query(f"SELECT count(*) FILTER (source <> target) = 0 AS is_identity, count(*) FILTER (source = target) AS n_same FROM {_MANY_SQL}")
def identity_check(spark, sf_dir):
    rules = spark.createDataFrame(_MANY, "source string, target string")
    return rules.agg((F.count_if(F.col("source") != F.col("target")) == 0).alias("is_identity"), F.count_if(F.col("source") == F.col("target")).alias("n_same"))


_LINEAGE = [("lit", "base"), ("lit", "prose"), ("prose", "base"), ("lex", "base"), ("page", "lit"), ("page", "meta"), ("letters", "prose")]
_ROUTES = [("md", "html"), ("html", "org"), ("html", "rst"), ("org", "html"), ("lit", "docbook"), ("lit", "html"), ("docbook", "lit"), ("djot", "md"), ("rst", "html"), ("djot", "lit")]
_FILES = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e"), ("f", "d"), ("d", "g"), ("b", "f")]


def _values(pairs, a, b):
    return "(VALUES " + ", ".join(f"('{x}', '{y}')" for x, y in pairs) + f") AS t({a}, {b})"


@query(f"""WITH RECURSIVE e AS (SELECT * FROM {_values(_LINEAGE, 'child', 'parent')}), up(child, ancestor, depth) AS (SELECT child, parent, 1 FROM e UNION ALL SELECT up.child, e.parent, depth + 1 FROM up JOIN e ON up.ancestor = e.child)
SELECT child, ancestor, min(depth) AS depth FROM up GROUP BY child, ancestor""")
def lineage_closure(spark, sf_dir):
    return graphs.closure(spark, spark.createDataFrame(_LINEAGE, "child string, parent string"))


@query(f"""WITH RECURSIVE e AS (SELECT * FROM {_values(_ROUTES, 'src', 'dst')}), go(src, dst, hops, path) AS (SELECT src, dst, 1, [src, dst] FROM e UNION ALL SELECT go.src, e.dst, hops + 1, list_append(path, e.dst) FROM go JOIN e ON go.dst = e.src WHERE NOT list_contains(path, e.dst)),
least AS (SELECT src, dst, min(hops) AS hops FROM go GROUP BY src, dst)
SELECT src, dst, hops, count(*) AS n_routes, min(array_to_string(path, '>')) AS route FROM go JOIN least USING (src, dst, hops) GROUP BY src, dst, hops""")
def shortest_routes(spark, sf_dir):
    return graphs.shortest_routes(spark, spark.createDataFrame(_ROUTES, "src string, dst string"))


@query(f"""WITH RECURSIVE e AS (SELECT * FROM {_values(_FILES, 'src', 'dst')}), go(file, here, path, cyc) AS (SELECT src, dst, [src, dst], src = dst FROM e UNION ALL SELECT file, e.dst, list_append(path, e.dst), e.dst = file FROM go JOIN e ON go.here = e.src WHERE NOT cyc AND (e.dst = file OR NOT list_contains(path, e.dst)))
SELECT file, min(array_to_string(path, '>')) AS chain FROM go WHERE cyc GROUP BY file""")
def include_cycles(spark, sf_dir):
    return graphs.inclusion_cycles(spark, spark.createDataFrame(_FILES, "src string, dst string"))


# The token table.


@query(rf"""SELECT doc_id, CAST(s - 1 AS INTEGER) AS sent, CAST(k AS INTEGER) AS tok, w AS form FROM (SELECT doc_id, s, unnest(x) AS w, generate_subscripts(x, 1) AS k FROM (
  SELECT doc_id, s, list_filter(regexp_split_to_array(l, '{_WS}+'), lambda w: w <> '') AS x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS s FROM documents)))""")
def token_table(spark, sf_dir):
    """One sentence a line, one token a word."""
    sentences = texts(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("sent", "line"))
    found = sentences.select("doc_id", "sent", F.posexplode(text.words(F.col("line"))).alias("k", "form"))
    return found.select("doc_id", "sent", (F.col("k") + 1).alias("tok"), "form")


@query(rf"""WITH t AS (SELECT doc_id, s, unnest(x) AS w, generate_subscripts(x, 1) AS k, len(x) AS n FROM (
  SELECT doc_id, s, list_filter(regexp_split_to_array(l, '{_WS}+'), lambda w: w <> '') AS x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS s FROM documents)))
SELECT a.w AS form, b.w AS head, count(*) AS n FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.s = b.s AND b.k = a.k // 2 WHERE a.k >= 2 GROUP BY ALL HAVING count(*) > 20""")
def head_join(spark, sf_dir):
    """Tokens with their heads (here the token at half their place). A sentence's tokens are one row, so no join is shuffled."""
    sentences = texts(spark, sf_dir).select(F.explode(F.split("text", "\n")).alias("line")).select(text.words(F.col("line")).alias("w"))
    pairs = F.transform(F.sequence(F.lit(2), F.size("w")), lambda k: F.struct(F.get("w", k - 1).alias("form"), F.get("w", F.floor(k / 2).cast("int") - 1).alias("head")))
    found = sentences.where(F.size("w") >= 2).select(F.explode(pairs).alias("p")).select("p.form", "p.head")
    return found.groupBy("form", "head").agg(F.count(F.lit(1)).alias("n")).where("n > 20")


# Documents and witnesses: work inside one row or one coordinate, beyond what SQL expresses.


def _markdown(spark, sf_dir):
    """Documents as Markdown: the first word of a text as a heading over it."""
    docs = table(spark, sf_dir, "documents")
    text_ = F.concat(F.lit("# "), F.regexp_extract("text", r"^(\S*)", 1), F.lit("\n\n"), F.col("text"))
    return docs.select("doc_id", F.lit("md").alias("extension"), text_.alias("text"))


@query()
def markdown_nodes(spark, sf_dir):
    found = documents.nodes(_markdown(spark, sf_dir)).where("status = 'ok'")
    return found.groupBy("kind", "symbol").agg(F.count(F.lit(1)).alias("n"))


@query()
def markdown_canonical(spark, sf_dir):
    return documents.canonical(_markdown(spark, sf_dir)).select("doc_id", "status", "error_kind", "content_id")


@query("SELECT page_id AS doc_id, 'error' AS status, 'Syntax' AS error_kind FROM pages")
def html_strict_status(spark, sf_dir):
    """Every page of this table holds elements that the strict reader rejects."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit("html").alias("extension"), F.col("html").alias("text"))
    return documents.check(pages).select("doc_id", "status", "error_kind")


@query()
def subdivide_rounds(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    one = items.select(F.col("item_id").alias("work"), F.lit("A").alias("witness"), F.lit(0).alias("pos"), F.lit("1").alias("coord"), "text")
    other = one.withColumn("witness", F.lit("B")).withColumn("text", F.lower("text"))
    return witnesses.subdivide(one.union(other), 120)


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("work"), F.col("role").alias("witness"), F.col("turn").alias("pos"), F.floor(F.col("turn") / 4).cast("string").alias("coord"), "text")


@query()
def quasi_paths(spark, sf_dir):
    return witnesses.cut_paths(_turns(spark, sf_dir), 200)


@query()
def collate_words(spark, sf_dir):
    """Benchmark items against themselves with words dropped, replaced and added."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("work"), F.lit("B").alias("witness"), F.lit(0).alias("pos"), F.lit("1").alias("coord"), "text")
    words = F.split("text", " ")
    changed = F.array_join(F.flatten(F.transform(words, lambda w, k: F.when(k % 7 == 3, F.array().cast("array<string>")).when(k % 11 == 5, F.array(w, F.lit("added"))).when(k % 13 == 6, F.array(F.upper(w))).otherwise(F.array(w)))), " ")
    return witnesses.collate(items.union(items.withColumn("text", changed).withColumn("witness", F.lit("T"))), "B")


@query()
def aligned_order(spark, sf_dir):
    return witnesses.aligned_order(_turns(spark, sf_dir).groupBy("work", "witness", "coord").agg(F.min("pos").alias("pos")))


@query("SELECT conv_id, turn // 4 AS coord, role AS witness, count(*) AS n FROM conversations GROUP BY ALL HAVING count(*) > 1")
def coord_repeats(spark, sf_dir):
    found = witnesses.repeated_coordinates(_turns(spark, sf_dir))
    return found.select(F.col("work").alias("conv_id"), F.col("coord").cast("long").alias("coord"), "witness", "n")


@query()
def markdown_to_html(spark, sf_dir):
    """Markdown read, mapped to the HTML schema by its lineage, and rendered by the built-in table."""
    out = documents.export(_markdown(spark, sf_dir), "at-html", "html")
    return out.select("doc_id", "status", "error_kind", F.length("rendered").alias("n_chars"), F.md5("rendered").alias("rendered_md5"))


# Line formats and composed coordinates.


@query(rf"""SELECT doc, sent, tok, form, CASE WHEN tok > 1 THEN tok - 1 END AS head, form[:3] AS lemma FROM (
  SELECT doc_id AS doc, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS sent, CAST(k AS INTEGER) AS tok, w AS form FROM (
    SELECT doc_id, s, unnest(x) AS w, generate_subscripts(x, 1) AS k FROM (SELECT doc_id, s, list_filter(regexp_split_to_array(l, '{_WS}+'), lambda w: w <> '') AS x
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS s FROM documents))))""")
def conllu_tokens(spark, sf_dir):
    """Documents as token files, a line of text a sentence, each word headed by the one before it."""
    words = lambda line: text.words(line)
    row = lambda w, k: F.concat_ws("\t", (k + 1).cast("string"), w, F.substring(w, 1, 3), F.lit("X"), F.lit("_"), F.lit("_"), k.cast("string"), F.lit("dep"), F.lit("_"), F.lit("_"))
    sentence = lambda line: F.array_join(F.transform(words(line), row), "\n")
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.array_join(F.transform(F.split("text", "\n"), sentence), "\n\n").alias("text"))
    return corpora.conllu_tokens(files).select("doc", "sent", "tok", "form", "head", "lemma")


@query("""SELECT n_regionkey + 1 AS doc, 1 AS sura, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INTEGER) AS aya, n_name AS text, CAST(NULL AS VARCHAR) AS error FROM nation""")
def numbered_verses(spark, sf_dir):
    """A region's nations as numbered lines."""
    by = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("xs"))
    lines = F.transform("xs", lambda x, k: F.concat(F.lit("1|"), k + 1, F.lit("|"), x["n_name"]))
    return corpora.numbered_verses(by.select((F.col("n_regionkey") + 1).alias("doc"), F.array_join(lines, "\n").alias("text")))


@query("""SELECT event_id, user_id || '.' || chapter || CASE WHEN event_type = 'click' THEN '.' || event_id ELSE '' END AS coordinate FROM (
  SELECT *, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS chapter FROM events)
WHERE event_type IN ('signup', 'click') AND chapter IS NOT NULL""")
def composed_coordinates(spark, sf_dir):
    """Chapter and verse marks composed to ``book.chapter.verse`` by the chapter at or before them."""
    marks = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type").where("event_type IN ('signup', 'click')")
    found = rows.anchor_asof(marks, ["user_id"], ["event_id"], F.when(F.col("event_type") == "signup", F.col("event_id")), "chapter")
    verse = F.when(F.col("event_type") == "click", F.col("event_id").cast("string"))
    return found.where("chapter IS NOT NULL").select("event_id", F.concat_ws(".", F.col("user_id").cast("string"), F.col("chapter").cast("string"), verse).alias("coordinate"))
