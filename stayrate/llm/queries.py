"""The text operators as queries over the given tables, and the SQL that some are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayrate.functions.ordering import number_rows
from stayrate.llm import bpe, chat, fingerprint, lang_id, line_dedup, lm_score, mixing, near_dedup, packing, phrases, prefix_trie, quality, url_filter
from stayrate.llm.common import Query, table, text_or_empty

#: The rules of the url query: host, path, action.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url against the five rules; urls that no rule fits are allowed."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


ORACLE["op1_url_filters"] = """
with rules(host, path, action) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u as (select page_id,
  translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') as path from pages),
hit as (select u.page_id, u.host, u.path, r.host || r.path as rule, r.action,
  row_number() over (partition by u.page_id order by length(r.host || r.path) desc) as n
  from u join rules r on (u.host = r.host or u.host like '%.' || r.host) and starts_with(u.path, r.path))
select u.page_id, u.host, u.path, h.rule, coalesce(h.action, 'allow') as verdict
from u left join hit h on h.page_id = u.page_id and h.n = 1
"""


@query
def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited version, and their likenesses.

    Each text asks the next one (by descending id) for the part that replaces its end. Texts are shuffled once by id and
    hash, for both joins; from then on only the lent parts move. Equal rows are one text with a number of copies: the last copy asks
    the next text, the others ask the text itself.
    """
    key = ["id", "mark"]
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    docs = docs.select("*", F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text", F.col("doc_id").isNull()).alias("mark"))
    size = F.length("text").cast("bigint")
    distinct = docs.select("doc_id", *key, size.alias("n")).groupBy("doc_id", *key, "n").agg(F.count(F.lit(1)).alias("copies"))
    placed = number_rows(distinct, [F.col("doc_id").desc_nulls_last(), F.col("mark").asc()], total="all")
    askers = placed.select(
        (F.col("row_no") % F.col("all") + 1).alias("next"), F.col("id").alias("a_id"), F.col("mark").alias("a_mark"),
        F.col("doc_id").alias("a_doc"), F.col("n").alias("a_n"), "copies",
    )
    asks = placed.select(*key, F.col("row_no").alias("next")).join(askers, "next").drop("next")
    # the same columns on both sides, so that the second join reads the first one's exchange
    texts = docs.select(*key, "text").dropDuplicates(key)
    third = lambda n: F.floor(F.col(n) / 3).cast("int")
    lent = texts.join(asks, key).select(
        F.col("a_doc").alias("doc_id"), F.col("a_id").alias("id"), F.col("a_mark").alias("mark"), F.col("a_n").alias("n"), "copies",
        F.substring("text", F.lit(1), third("a_n")).alias("end"), fingerprint.digests(F.col("text")).alias("lent_digests"),
    )
    own = texts.join(lent, key).select("*", fingerprint.digests(F.col("text")).alias("digests"))
    part = lambda end, of, times: F.struct(end.alias("end"), of.alias("next_digests"), times.alias("times"))
    last = part(F.col("end"), F.col("lent_digests"), F.lit(1).cast("bigint"))
    others = part(F.substring("text", F.lit(1), third("n")), F.col("digests"), F.col("copies") - 1)
    start = F.substring("text", F.lit(1), (F.col("n") - third("n")).cast("int"))
    parts = F.when(F.col("copies") > 1, F.array(last, others)).otherwise(F.array(last))
    met = own.select("doc_id", "n", "digests", start.alias("start"), parts.alias("parts"))
    met = met.select("doc_id", "n", "digests", "start", F.inline("parts")).select("doc_id", "n", "digests", "next_digests", "times", F.concat("start", "end").alias("edited"))
    met = met.select("*", fingerprint.digests(F.col("edited")).alias("edited_digests"))
    made = met.select(
        "*",
        *[fingerprint.sketch(F.col(c)).alias(c.replace("digests", "sketch")) for c in ("digests", "edited_digests", "next_digests")],
    )
    like = lambda other: fingerprint.likeness(F.col("digests"), F.col(f"{other}_digests"), F.col("sketch"), F.col(f"{other}_sketch"))
    return made.select(
        "doc_id",
        F.col("n").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint.fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        like("edited").alias("near_edited"),
        like("next").alias("near_next"),
        F.sequence(F.lit(1).cast("bigint"), F.col("times")).alias("__each"),
    ).withColumn("__each", F.explode("__each")).drop("__each")


@query
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target of every document's source and the words that the mix takes from it."""
    return mixing.taken(table(spark, sf_dir, "documents"))


@query
def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, duplicate group and whether it stays, for every document."""
    return near_dedup.groups(table(spark, sf_dir, "documents"), null_ids=True)


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of every document with the bits and the verdict of policy v2."""
    entries = quality.judged(quality.ledger(table(spark, sf_dir, "documents")), "v2")
    return entries.select(
        "doc_id",
        *quality.MEASURES,
        F.col("failed").bitwiseAND(F.lit(quality.POLICIES["v2"])).alias("failed"),
        (F.col("failed").bitwiseAND(F.lit(quality.BASE)) != 0).alias("base_failed"),
        "kept",
    )


ORACLE["op5_quality_rules"] = r"""
with t as (select doc_id, coalesce(text, '') as text from documents),
s as (select doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from t),
w as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i from s),
g as (select doc_id, i, w || ' ' || lead(w, 1) over d || ' ' || lead(w, 2) over d || ' ' || lead(w, 3) over d || ' ' || lead(w, 4) over d as g
  from w window d as (partition by doc_id order by i)),
c as (select doc_id, i, count(*) over (partition by doc_id, g) as c from g where g is not null),
r as (select doc_id, count(distinct i + j) as n from c, range(0, 5) x(j) where c >= 2 group by doc_id),
m as (select s.doc_id, len(ws) as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) as n_symbols, len(ls) as n_lines,
  len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words,
  length(text) - length(regexp_replace(text, '\p{L}+', '', 'g')) as n_letters,
  length(text) - length(regexp_replace(text, '\p{Lu}+', '', 'g')) as n_capitals,
  length(text) - length(regexp_replace(text, '!+', '', 'g')) as n_exclamations,
  length(text) - length(regexp_replace(text, '[0-9]+', '', 'g')) as n_digits
  from s left join r using (doc_id)),
f as (select *, (n_words < 10)::int + 2 * (100 * n_repeat_words > 20 * n_words)::int + 4 * (10 * n_symbols > n_words)::int
  + 8 * (10 * n_dup_lines > 3 * n_lines)::int + 16 * (word_chars < 2 * n_words)::int + 32 * (word_chars > 14 * n_words)::int
  + 64 * (2 * n_letters < word_chars)::int + 128 * (2 * n_capitals > n_letters)::int
  + 256 * (5 * n_exclamations > n_words)::int + 512 * (4 * n_digits > word_chars)::int as failed from m)
select *, failed & 3 <> 0 as base_failed, failed = 0 as kept from f
"""


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before, lines dropped and digest of the text that stays, for every document."""
    cut = line_dedup.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=("n_lines", "n_dropped"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE["op6_line_dedup"] = r"""
with t as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents),
k as (select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from t),
bad as (select key from k where length(key) >= 1 group by key having count(distinct doc_id) >= 10),
m as (select k.*, b.key is not null as gone from k left join bad b using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from m group by doc_id
"""


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document in windows of 4096 ids."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by a model from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    rows = docs.select("doc_id", "text", "lang", held_out.alias("held_out"))
    return lang_id.predict(rows, lang_id.train(rows, ~F.col("held_out")), ["doc_id", "held_out"])


@query
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and scores of every document by what the rows that are not held out teach."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    return lm_score.score(rows, ~F.col("held_out"), ["doc_id", "held_out"])


@query
def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one made of control strings, formatted and read back."""
    odd = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(odd).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat.read_back(chat.examples(rows)).drop("conv_key")


ORACLE["op9_chat_formatting"] = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all
  values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (select *, row_number() over w as i, count(*) over (partition by conv_id) as n,
  length(regexp_replace(text, '([<\[])(~*)(/?)(s>|INST\])', '\1~\2\3\4', 'g'))
  + case when role = 'assistant' then 4 else 16 + length(role) end as size from t window w as (partition by conv_id order by turn, role, text)),
c as (select *, sum(size) over (partition by conv_id order by i) as upto from e)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) as loss_sha256,
  sum(upto) filter (role = 'assistant' or i = n)::bigint as formatted_chars
from c group by conv_id
"""


def _rebuilt(convs: DataFrame) -> DataFrame:
    """Each conversation with its first turns from the conversation at the last full hundred; how many, a hash of its id says."""
    c = F.col("conv_id")
    taken = (F.crc32(c.cast("string").cast("binary")) % 6).cast("int")
    firsts = convs.where(c % 100 == 0).select(c.alias("base"), F.slice("turns", 1, 5).alias("firsts"))
    met = convs.select("conv_id", "turns", taken.alias("h"), (c - c % 100).alias("base")).join(firsts, "base", "left")
    theirs = F.slice(F.coalesce("firsts", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    return met.select("conv_id", F.concat(theirs, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    found = prefix_trie.trie(_rebuilt(prefix_trie.conversations(table(spark, sf_dir, "conversations"))))
    nodes = found.nodes.join(prefix_trie.end_digests(found.ends), "node", "left")
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


ORACLE["op11_prefix_trie"] = r"""
with recursive ids as (select distinct conv_id from conversations where conv_id is not null),
crc(conv_id, s, i, c) as (select conv_id, conv_id::varchar, 0, 4294967295::bigint from ids
  union all select conv_id, s, i + 1, list_reduce([xor(c, ascii(s[i + 1])::bigint), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, y: xor(x >> 1, 3988292384 * (x & 1))) from crc where i < length(s)),
h as (select conv_id, xor(c, 4294967295) % 6 as h from crc where i = length(s)),
d as (select conv_id, turn, length(coalesce(text, '')) as chars,
  md5(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as d from conversations),
t as (select *, row_number() over (partition by conv_id order by turn nulls first, d) as i from d),
r as (select h.conv_id, 0 as part, t.i, t.d, t.chars from h join t on t.conv_id = h.conv_id - h.conv_id % 100 and t.i <= h.h
  union all select conv_id, 1, i, d, chars from t join h using (conv_id) where i > h.h),
n as (select conv_id, d, chars, row_number() over (partition by conv_id order by part, i) as depth from r),
p as (select conv_id, depth, chars, string_agg(d, '') over (partition by conv_id order by depth) as path from n
  union all select conv_id, 0, 0, '' from ids),
l as (select conv_id, max(depth) as len from p group by conv_id),
v as (select path, depth, any_value(chars) as chars, min(conv_id) as conv_id, count(*) as n_convs,
  sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (len = depth), '')) as ends_sha256
  from p join l using (conv_id) group by path, depth),
k as (select left(path, 32 * (depth - 1)) as path, count(*) as n_children from v where depth > 0 group by 1),
a as (select v.*, coalesce(n_children, 0) as n_children from v left join k using (path)),
u as (select left(path, (32 * x)::bigint) as path, sum((n_children = 0)::int) as n_leaves, sum((n_convs - 1) * chars) as saved_tokens
  from a, range(0, depth + 1) r(x) group by 1)
select a.conv_id, a.depth, b.conv_id as parent_conv_id, a.n_convs, a.n_children, u.n_leaves::bigint as n_leaves,
  u.saved_tokens::bigint as saved_tokens, a.ends_sha256
from a join u using (path) left join a b on a.depth > 0 and b.path = left(a.path, 32 * (a.depth - 1))
"""


@query
def op12_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of ids, and digests of the ids and of the decoded text, for every document."""
    made = bpe.encode(table(spark, sf_dir, "documents"), digests=True)
    return made.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})


@query
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language."""
    found = phrases.first_ranked(phrases.collocations(table(spark, sf_dir, "documents")))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE["op13_phrase_collocations"] = r"""
with t as (select row_number() over () as id, coalesce(lang, 'und') as lang,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
p as (select id, lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) as piece from t),
q as (select row_number() over () as pid, lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from p),
x as (select pid, lang, unnest(ws) as w, generate_subscripts(ws, 1) as i from q),
y as (select lang, w, lead(w, 1) over o as x, lead(w, 2) over o as y, lead(w, 3) over o as z from x window o as (partition by pid order by i)),
g as (select lang, 1 as m, w as phrase from y union all select lang, 2, w || ' ' || x from y where x is not null
  union all select lang, 3, w || ' ' || x || ' ' || y from y where y is not null
  union all select lang, 4, w || ' ' || x || ' ' || y || ' ' || z from y where z is not null),
f as (select lang, m, phrase, count(*) as f from g group by all),
n as (select lang, sum(f) as n from f where m = 1 group by lang),
c as (select lang, m, phrase, f as a, string_split(phrase, ' ') as ws from f where m > 1 and f >= 30),
k as (select c.*, k, array_to_string(ws[1:k], ' ') as one, array_to_string(ws[k + 1:], ' ') as two from c, range(1, 4) r(k) where k < m),
s as (select k.lang, k.phrase, k.a, k.k, x.f as l, y.f as r, (2000000::hugeint * k.a) // (x.f + y.f) as score
  from k join f x on x.lang = k.lang and x.phrase = k.one join f y on y.lang = k.lang and y.phrase = k.two),
b as (select lang, phrase, a, unnest(min(struct_pack(score := score, k := k, l := l, r := r))) from s group by lang, phrase, a),
i as (select lang, array_to_string(ws[o:o + z - 1], ' ') as phrase, max(a) as longer from c, range(2, 4) r(z), range(1, 4) u(o)
  where z < m and o + z - 1 <= m group by 1, 2),
d as (select b.* from b left join i using (lang, phrase) where i.longer is null or 100::hugeint * i.longer < 80::hugeint * b.a)
select lang, rank, phrase, a, l, r, n::bigint as n, score::bigint as score from (select d.*, n.n,
  row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from d join n using (lang)) where rank <= 2000
"""


def registered() -> dict[str, Query]:
    return dict(QUERIES)


def statements() -> dict[str, str]:
    return dict(ORACLE)
