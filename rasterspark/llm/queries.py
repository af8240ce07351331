"""The queries of this subpackage and, where SQL can say it, the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    cover_anchors, decontaminate, html_content, licenses, lm_scoring, merkle, mixture, ngram_join, quality, revisits, spelling, suffix_dedup,
    toxicity,
)

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(fn):  # noqa: ANN001, ANN202
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that already occurred in a 100-byte string before it, removed."""
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@_query
def op3_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    mixed = mixture.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


SQL["op3_source_mixture"] = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size from documents),
s as (select source, sum(size)::bigint source_size from d group by source),
r as (select *, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3) + 1]::bigint weight from s),
l as (select *, 3 * source_size cap, (3 * source_size) / weight full_at from r),
o as (select *, sum(cap) over w - cap before_it, sum(weight) over (order by full_at, source nulls last rows between current row and unbounded following) open_w,
  sum(source_size) over () whole_size, row_number() over w place from l window w as (order by full_at, source nulls last rows unbounded preceding)),
c as (select min_by(((whole_size - before_it)::bigint) / (open_w::bigint), place) common from o
  where ((whole_size - before_it)::bigint) / (open_w::bigint) <= full_at),
t as (select source, source_size, case when full_at <= common then cap::double else common * weight end target from o, c),
m as (select doc_id, size, source_size, target, case when source_size > 0 then target / source_size else 0.0::double end rate,
  (('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint)::double / 4503599627370496.0::double u
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, (floor(rate)::bigint * size + case when size > 0 then floor((rate - floor(rate)) * size + u)::bigint else 0 end)::bigint taken from m
"""


@_query
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by a shingle similarity of 0.8 or more."""
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


@_query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@_query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside benchmark windows, and whether it is contaminated."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = decontaminate.hit_words(F.col("spans"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_words"), n_hit).alias("contaminated"),
    )


SQL["op10_decontaminate"] = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
g as (select distinct item_id, least(len(w), 13) k, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') gram
  from (select item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) i from b where len(w) > 0)),
k as (select distinct k from g),
h as (select doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') gram
  from (select doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) i from d, k where len(w) >= k)),
m as (select doc_id, item_id, i, g.k k from h join g on h.gram = g.gram and h.k = g.k),
p as (select doc_id, count(*) n_hit from (select distinct doc_id, i + j p from (select doc_id, i, unnest(generate_series(0, k - 1)) j from (select distinct doc_id, i, k from m))) group by doc_id),
n as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct doc_id, item_id::varchar item from m) group by doc_id)
select d.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(items, '')) items_sha256,
  coalesce(n_hit > 0 and 20 * n_hit >= len(w), false) contaminated from d left join p using (doc_id) left join n using (doc_id)
"""


@_query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by the clause grammar."""
    found = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def crawl_records(pages: DataFrame) -> DataFrame:
    """A crawl log of the pages: each is captured in full as a version of its section, and asked for again later.

    Record ids, times and validators follow from page_id; every answer to a repeated request says "not
    modified" with the ETag, the date or nothing.
    """
    tag = F.md5("html")
    at = F.timestamp_seconds(F.lit(1_600_000_000) + F.col("page_id") * 3600)
    section = F.regexp_replace("url", r"/\d+", "")
    day = F.date_format(at, "yyyy-MM-dd")
    full = pages.select(
        (F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("type"), section.alias("url"), at.alias("at"),
        F.map_filter(F.create_map(
            F.lit("etag"), tag, F.lit("last-modified"), day, F.lit("content-type"), F.lit("text/html"),
            F.lit("date"), F.date_format(at, "yyyy-MM-dd HH:mm"),
        ), lambda k, v: ~((k == "etag") & (F.col("page_id") % 4 == 3))).alias("headers"), F.col("html").alias("payload"),
    )
    later = F.timestamp_seconds(F.lit(1_600_001_800) + (F.col("page_id") + F.pmod("page_id", F.lit(5)) * 40 - 20) * 3600)
    again = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("type"), section.alias("url"), later.alias("at"),
        F.map_filter(F.create_map(
            F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("last-modified"), day, F.lit("content-type"), F.lit("text/plain"),
            F.lit("date"), F.date_format(later, "yyyy-MM-dd HH:mm"),
        ), lambda k, v: ~(((k == "etag") & (F.col("page_id") % 3 == 0)) | ((k == "last-modified") & (F.col("page_id") % 9 == 0)))).alias("headers"),
        F.lit(None).cast("string").alias("payload"),
    )
    return full.unionByName(again)


@_query
def op4_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every not-modified answer of a crawl log of the pages, with the full response it stands for."""
    found = revisits.resolve_revisits(crawl_records(table(spark, sf_dir, "pages")))
    return found.select(
        "record_id", "canonical", "status", "response_id", F.md5("payload").alias("payload_md5"),
        *(F.col("headers")[k].alias(k.replace("-", "_")) for k in ("etag", "last-modified", "content-type", "date")),
    )


SQL["op4_revisit_resolution"] = r"""
with p as (select page_id, html, md5(html) tag, regexp_replace(url, '/\d+', '', 'g') u, 1600000000 + page_id * 3600 t0,
  1600001800 + (page_id + (page_id % 5) * 40 - 20) * 3600 t1 from pages),
n as (select *, regexp_replace(regexp_replace(trim(u), '#.*$', ''), '^https?://', '', 'i') s from p),
c as (select *, regexp_replace(lower(regexp_extract(s, '^([^/?]*)', 1)), ':(80|443)$', '') || regexp_replace(regexp_extract(s, '^[^/?]*([^?]*)', 1), '/+$', '')
  || case when len(q) > 0 then '?' || array_to_string(list_sort(q), '&') else '' end canonical
  from (select *, list_filter(string_split(regexp_extract(s, '\?(.*)$', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)')) q from n)),
m as (select a.page_id * 2 + 1 record_id, a.canonical canonical, a.tag atag, a.page_id apage, a.t0 at0, a.t1 at1, b.page_id bpage, b.tag btag, b.t0 bt0, b.html bhtml,
  row_number() over (partition by a.page_id order by b.t0 desc nulls last, b.page_id desc) k from c a left join c b on a.canonical = b.canonical and b.t0 < a.t1),
v as (select *, case when apage % 3 = 0 then null else atag end aetag, case when bpage % 4 = 3 then null else btag end betag,
  case when apage % 9 = 0 then null else strftime(make_timestamp(at0 * 1000000), '%Y-%m-%d') end amod, strftime(make_timestamp(bt0 * 1000000), '%Y-%m-%d') bmod from m where k = 1),
w as (select *, case when bpage is null then 'orphan' when aetag is not null and betag is not null then case when aetag = betag then 'resolved' else 'changed' end
  when amod is not null and bmod is not null then case when amod = bmod then 'resolved' else 'changed' end else 'unchecked' end status from v)
select record_id, canonical, status, bpage * 2 response_id, case when status in ('resolved', 'unchecked') then md5(bhtml) end payload_md5,
  case when status in ('resolved', 'unchecked') then coalesce('W/' || aetag, betag) end etag,
  case when status in ('resolved', 'unchecked') then bmod end last_modified, case when status in ('resolved', 'unchecked') then 'text/html' end content_type,
  case when status in ('resolved', 'unchecked') then strftime(make_timestamp(at1 * 1000000), '%Y-%m-%d %H:%M') end "date" from w
"""


@_query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of every document: lines that may hold one, those confirmed, and their licenses."""
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    named = F.filter("findings", lambda f: f["license"].isNotNull())
    return found.select(
        "doc_id", F.size("findings").cast("long").alias("n_blocks"), F.size(named).cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(named, lambda f: f["license"]))), ",").alias("licenses"),
    )


@_query
def op8_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = html_content.extract_pages(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@_query
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of every document under the unigram base and the model."""
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"))


def _crc_table() -> str:
    rows = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        rows.append(c)
    return f"{rows}::bigint[]"


def crc_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes in DuckDB SQL."""
    octets = f"list_transform(range(1, strlen({text}) + 1), lambda i: ('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::bigint)"
    step = f"lambda c, b: xor(c >> 8, ({_crc_table()})[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {octets}), {step}), 4294967295::bigint)"


@_query
def op11_cover_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside 20-word windows that occurred before, removed."""
    found = cover_anchors.remove_repeated_words(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"]).alias("n_removed"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


SQL["op11_cover_anchors"] = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
g as (select doc_id, i, array_to_string(w[i : i + 19], ' ') k from (select doc_id, w, unnest(generate_series(1, len(w) - 19)) i from d where len(w) >= 20)),
c as (select doc_id, i, row_number() over (partition by k order by doc_id, i) n from g),
r as (select distinct doc_id, i + j p from (select doc_id, i, unnest(generate_series(0, 19)) j from c where n > 1)),
u as (select doc_id, unnest(w) word, unnest(generate_series(1, len(w))) p from d),
k as (select doc_id, string_agg(word, ' ' order by p) kept, count(*) n from u anti join r using (doc_id, p) group by doc_id)
select doc_id, len(w)::bigint n_words, (len(w) - coalesce(n, 0))::bigint n_removed, sha256(coalesce(kept, '')) kept_sha256 from d left join k using (doc_id)
"""


@_query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the corpus with their near words, preferred forms and roots."""
    return spelling.group_variants(table(spark, sf_dir, "documents"), slip=199).select("word", "form", "root", "n", "n_near", "form_n")


SQL["op12_spelling_variants"] = f"""
with recursive t as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) r from documents),
c as (select r, n, {crc_sql("(doc_id::varchar || ':' || r)")} h from (select doc_id, r, count(*) n from t group by doc_id, r)),
v as (select case when h % 199 = 0 then substr(r, 1, (h % length(r))::bigint) || substr(r, (h % length(r))::bigint + 2) else r end word, sum(n)::bigint n from c group by 1),
w as (select word, n, length(word) len from v where length(word) >= 6 and n >= 5),
s as (select word, n, len, unnest(generate_series(1, len)) i from w),
x as (select word, n, substr(word, 1, i - 1) || '_' || substr(word, i + 1) gap, substr(word, 1, i - 1) || substr(word, i + 1) less from s),
p as (select a.word a, a.n an, b.word b, b.n bn from x a join x b on a.gap = b.gap and a.word <> b.word),
q as (select distinct x.word a, x.n an, w.word b, w.n bn from x join w on x.less = w.word),
m as (select a, an, b, bn from p union all select a, an, b, bn from q union all select b, bn, a, an from q),
f as (select a word, count(*) n_near, max(bn) form_n, arg_min(b, (-bn, b)) form from m group by a),
o as (select w.word, w.n, coalesce(n_near, 0)::bigint n_near, case when form_n >= 5 * w.n then form end form, case when form_n >= 5 * w.n then form_n end form_n from w left join f on f.word = w.word),
y as (select word, word root, 0 depth from o union all select y.word, o.form, depth + 1 from y join o on o.word = y.root where o.form is not null)
select word, form, arg_max(y.root, depth) root, any_value(n) n, any_value(n_near) n_near, any_value(form_n) form_n from o join y using (word) group by word, form
"""


@_query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusion proof of every document, checked against documents of which a fifth was tampered with."""
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    found = merkle.verify(table(spark, sf_dir, "documents"), {"text": merkle.ascii_lower(F.col("text"))}, tampered)
    return found.select(F.col("row_key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _merkle_sql(levels: int = 6) -> str:
    """Trees of up to 16 ** levels rows a source and as many sources."""
    field = lambda c, v=None: f"coalesce(strlen({v or c}::varchar)::varchar || ':' || {v or c}::varchar, '-')"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda text: "sha256(" + " || ".join([*(field(c) for c in ("doc_id", "source", "lang", "n_chars")), field("text", text)]) + ")"
    crc = crc_sql("doc_id::varchar")
    parts = [f"""with d as (select *, {leaf('text')} leaf, case when ({crc}) % 5 = 0 then {leaf(low)} end changed from documents),
a0 as (select doc_id, source tree, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 p, leaf h from d)"""]

    def up(name: str) -> None:
        for k in range(levels):
            parts.append(f"""{name}s{k} as (select *, count(*) over (partition by tree) size from {name}{k}),
{name}{k + 1} as (select tree, p // 16 p, case when any_value(size) = 1 then any_value(h) else sha256(string_agg(h, '' order by p)) end h from {name}s{k} group by tree, p // 16),
{name}f{k} as (select tree, p, h, size, coalesce(string_agg(h, '' order by p) over (partition by tree, p // 16 order by p rows between unbounded preceding and 1 preceding), '') l,
  coalesce(string_agg(h, '' order by p) over (partition by tree, p // 16 order by p rows between 1 following and unbounded following), '') r from {name}s{k})""")

    up("a")
    parts.append(f"b0 as (select 0 tree, tree source, row_number() over (order by tree nulls first) - 1 p, h from a{levels})")
    up("b")
    n = levels
    chain, joins = [], []
    for k in range(n):
        joins.append(f"join af{k} f{k} on f{k}.tree is not distinct from t.tree and f{k}.p = t.p // {16 ** k}")
        chain.append(f"f{k}")
    joins.append("join b0 s on s.source is not distinct from t.tree")
    for k in range(n):
        joins.append(f"join bf{k} g{k} on g{k}.p = s.p // {16 ** k}")
        chain.append(f"g{k}")
    steps = ", ".join(f"case when {c}.size > 1 then {{'l': {c}.l, 'r': {c}.r}} end" for c in chain)
    parts.append(f"""j as (select t.doc_id, d.leaf, d.changed, s.h subroot, (select h from b{n}) root, list_filter([{steps}], lambda x: x is not null) proof
  from (select a0.*, row_number() over (partition by doc_id order by tree, p) k from a0) t
  join (select *, row_number() over (partition by doc_id order by source, leaf) k from d) d on d.doc_id is not distinct from t.doc_id and d.k = t.k {' '.join(joins)}),
w as (select *, list_reduce(list_prepend({{'l': '', 'r': coalesce(changed, leaf)}}, proof), lambda h, x: {{'l': '', 'r': sha256(x.l || h.r || x.r)}}).r folded_root from j)""")
    return ",\n".join(parts) + "\nselect doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(proof, lambda x: x.l || x.r), '')) proof_sha256, folded_root, folded_root = root verified from w"


SQL["op13_merkle_manifest"] = _merkle_sql()
