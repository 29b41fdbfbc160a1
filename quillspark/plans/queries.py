"""The registered queries of the content engine over the test tables, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark import settings
from quillspark.functions import images, records, scores, texts, times, urls
from quillspark.io import table
from quillspark.operators import dedup, ingestion, publishing, relations, selection
from quillspark.sources import markup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Time-dependent queries are held at this instant.
NOW = "2024-01-15 09:30:00"
#: Tokens that occur in the tables' invented prose, as topic and priority signals.
SIGNALS = ((r"\b(the and|of the)\b", 0.30), (r"\bthis\b", 0.35), (r"\b(that|with)\b", 0.20), (r"\btoken\b", 0.25))


def query(oracle: str | None = None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


_PRIORITY_SQL = "least(1.0, round(" + " + ".join(f"case when regexp_matches(lower(text), '{p}') then {w} else 0.0 end" for p, w in SIGNALS) + ", 3))"


@query(
    f"""with scored as (select d.doc_id as id, {_PRIORITY_SQL} as priority, l.quality::double as quality, d.n_chars as ready_at
        from documents d left join labels l using (doc_id)
        where not exists (select 1 from labels x where x.doc_id = d.doc_id and x.toxic = 1)),
    waiting as (select * from scored where priority >= 0.2 order by ready_at, id limit 100)
    select id, priority, quality, ready_at from waiting order by priority desc, coalesce(quality, -1) desc, ready_at, id limit 1"""
)
def best_ready_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    waiting = relations.not_sent(docs.select(F.col("doc_id").alias("id"), "text", F.col("n_chars").alias("ready_at")), labels.where("toxic = 1"), "id", "doc_id")
    # behind a generator the score is a column of its own, which the filter on it doesn't compute again
    waiting = waiting.select("id", F.explode(F.array(scores.priority(F.col("text"), SIGNALS))).alias("priority"), "ready_at")
    quality = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("quality"))
    return relations.best_candidate(waiting.join(quality, "id", "left"), 0.2).select("id", "priority", "quality", "ready_at")


@query(f"select doc_id, {_PRIORITY_SQL} as priority from documents")
def article_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", scores.priority(F.col("text"), SIGNALS).alias("priority"))


# DuckDB has no parser of URLs: the parts are cut out by expressions.
_HOST = "lower(regexp_extract({u}, '^[a-z]+://(?:[^/@?#]*@)?([^/:?#]+)', 1))"
_PATH = "regexp_extract({u}, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_QUERY = "regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1)"
_NORMAL = (
    f"{_HOST} || case when regexp_replace({_PATH}, '/+$', '') = '' then '/' else regexp_replace({_PATH}, '/+$', '') end || "
    f"coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split({_QUERY}, '&'), lambda p: p <> '' and not regexp_matches(lower(p), '^({'|'.join(settings.TRACKING_PREFIXES)})'))), '&'), ''), '')"
)


def _sql(text: str, column: str = "url") -> str:
    return text.replace("{u}", column)


@query(f"select page_id, {_sql(_NORMAL)} as canonical_url from pages")
def url_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.normalise(F.col("url")).alias("canonical_url"))


@query(f"select page_id, canonical_url, min(page_id) over (partition by canonical_url) as canonical, min(page_id) over (partition by canonical_url) <> page_id as is_duplicate from (select page_id, {_sql(_NORMAL)} as canonical_url from pages)")
def url_dedup_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.lit("page").alias("kind"))
    return dedup.by_url(pages, "url", "kind", "page_id").select("page_id", "canonical_url", "canonical", "is_duplicate")


@query(
    f"""select page_id, host, first_segment, stem, host || '|' || case when length(stem) < 8 then lower(trim(path, '/')) else lower(stem) end as rendition_key
    from (select page_id, {_sql(_HOST)} as host, {_sql(_PATH)} as path, nullif(lower(string_split(trim({_sql(_PATH)}, '/'), '/')[1]), '') as first_segment,
    regexp_replace(regexp_extract({_sql(_PATH)}, '([^/]*)/*$', 1), '\\.[^.]*$', '') as stem from pages)"""
)
def rendition_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.host(u).alias("host"), urls.first_segment(u).alias("first_segment"), urls.stem(u).alias("stem"), urls.rendition_key(u).alias("rendition_key"))


@query(
    f"""with p as (select page_id, {_sql(_HOST)} as host, string_split(trim({_sql(_PATH)}, '/'), '/') as s from pages)
    select page_id, host like '%.com' and s[1] <> '' and not list_has_any(list_transform(s, lambda x: lower(x)), {urls.EXCLUDED_SEGMENTS!r}) and not regexp_full_match(s[-1], '[0-9]+') and
    (len(list_filter(s[1:-2], lambda x: regexp_full_match(x, '(19|20)[0-9]{{2}}'))) > 0 or (list_contains({urls.CONTENT_SECTIONS!r}, lower(s[1])) and len(s) >= 2) or (lower(s[1]) = 'en' and len(s) >= 2)
    or (len(s) = 1 and length(s[1]) - length(replace(s[1], '-', '')) >= 3)) as is_article from p"""
)
def article_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = urls.host(F.col("url"))
    allowed = F.when(host.like("%.com"), F.array(host)).otherwise(F.array(F.lit("")))
    return table(spark, sf_dir, "pages").select("page_id", urls.is_article_url(F.col("url"), allowed, F.lit("en")).alias("is_article"))


@query("select page_id, regexp_extract(url, '^[a-z]+', 0) || '://' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as logged from pages")
def redact_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.without_secrets(F.col("url")).alias("logged"))


#: A page of a made layout around what a row says, so that SQL can tell what an extractor must find in it.
_MADE = "'<html><head><meta property=\"og:image\" content=\"/og' || page_id || '.jpg\"><title>Story ' || page_id || '</title></head><body><nav><a href=\"/menu\">m</a></nav><article><h1>Story ' || page_id || '</h1><p>' || {p} || '</p><p>' || {p} || '</p><p>short</p><time datetime=\"2024-01-' || lpad((1 + page_id % 28)::varchar, 2, '0') || 'T08:00:00Z\">x</time>' || case when page_id % 3 = 0 then '<img src=\"/a' || page_id || '.jpg\" width=\"800\" height=\"500\">' else '' end || case when page_id % 5 = 0 then '<iframe src=\"https://www.youtube.com/embed/v' || page_id || '\"></iframe>' else '' end || '</article><a href=\"/news/story-' || (page_id + 1) || '#top\">next</a></body></html>'"
_PARAGRAPH = "A paragraph of the made story, which is long enough to be one and says so in a good many words, as prose does that wants to be read as such."


def _made_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages by column functions; Spark reads that expression as SQL."""
    made = _MADE.replace("{p}", f"'{_PARAGRAPH}'").replace("::varchar", "")
    made = made.replace("lpad((1 + page_id % 28), 2, '0')", "lpad(cast(1 + page_id % 28 as string), 2, '0')")
    return table(spark, sf_dir, "pages").select("page_id", F.lit("https://example.com/news/").alias("url"), F.expr(made).alias("html"))


@query(f"select page_id, 'Story ' || page_id as title, '{_PARAGRAPH}' || E'\\n\\n' || '{_PARAGRAPH}' as content, make_timestamp(2024, 1, 1 + page_id % 28, 8, 0, 0.0) as published_at from pages")
def html_article_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _made_pages(spark, sf_dir).select("page_id", markup.article_udf("html").alias("a"))
    date = F.transform("a.published", lambda t: times.parse_date(t, F.lit("2024-03-01").cast("timestamp")))
    return found.select("page_id", "a.title", "a.content", F.try_element_at(F.array_compact(date), F.lit(1)).cast("timestamp_ntz").alias("published_at"))


@query("select page_id, 0 as position, 'https://example.com/menu' as link from pages union all select page_id, 1, 'https://example.com/news/story-' || (page_id + 1) from pages")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _made_pages(spark, sf_dir).select("page_id", F.posexplode(markup.links_udf("html", "url")).alias("position", "link"))
    return found.withColumn("link", F.regexp_replace("link", "#.*$", ""))


@query(
    """select page_id, 'https://example.com/og' || page_id || '.jpg' as url, 'image' as type, 'og_meta' as extracted_by, null::int as width from pages
    union all select page_id, 'https://example.com/a' || page_id || '.jpg', 'image', 'html_img', 800 from pages where page_id % 3 = 0
    union all select page_id, 'https://www.youtube.com/embed/v' || page_id, 'embed', 'html_iframe', null from pages where page_id % 5 = 0"""
)
def html_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _made_pages(spark, sf_dir).select("page_id", F.explode(markup.media_udf("html", "url")).alias("m"))
    return pages.select("page_id", "m.url", "m.type", "m.extracted_by", "m.width")


@query("select doc_id, regexp_matches(text, '(?i)(?:^|[^\\p{L}\\p{N}_])(?:the\\s+of|token|license)(?:$|[^\\p{L}\\p{N}_])') as on_topic from documents")
def keyword_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", texts.is_on_topic(F.col("text"), ["the of", "token", "license"]).alias("on_topic"))


_STOP = "', '".join(settings.STOPWORDS)
_TOKENS = f"list_filter(regexp_split_to_array(lower({{u}}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '' and not list_contains(['{_STOP}'], w))"


@query(
    f"""with i as (select item_id, text, row_number() over (order by item_id) - 1 as number from benchmark), n as (select count(*) as of from i),
    p as (select d.doc_id, i.item_id, {_sql(_TOKENS, 'i.text')} as a, list_distinct({_sql(_TOKENS, 'd.text')}) as t from documents d cross join n join i on i.number = d.doc_id % n.of)
    select doc_id, item_id, case when len(a) = 0 or len(t) = 0 then 0.2 else least(1.0, len(list_filter(a, lambda w: list_contains(t, w))) / greatest(3, len(a))::double) end as overlap from p"""
)
def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("title"))
    # each document meets the item whose number is its id modulo their count; numbers go by id, so that every item takes part
    ids = items.select("item_id").distinct()
    numbered = ids.select("item_id", (F.row_number().over(Window.orderBy("item_id")) - 1).alias("number"))
    one = docs.select("doc_id", "text").crossJoin(F.broadcast(ids.agg(F.count("*").alias("of")))).withColumn("number", F.when(F.col("of") > 0, F.pmod("doc_id", "of"))).drop("of")
    joined = one.join(numbered, "number").join(items, "item_id")
    return joined.select("doc_id", "item_id", scores.overlap(F.col("title"), F.col("text")).alias("overlap"))


@query("select doc_id, case when l = 0 then false else n / l >= 0.5 end as is_latin, l as n_letters from (select doc_id, len(regexp_extract_all(text, '\\p{L}'))::int as l, len(regexp_extract_all(text, '\\p{Latin}')) as n from documents)")
def script_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.struct(texts.count_of(F.col("text"), "L").alias("l"), texts.count_of(F.col("text"), "IsLatin").alias("n")))).alias("x"))
    return counted.select("doc_id", texts.is_of_script(F.col("x.l"), F.col("x.n")).alias("is_latin"), F.col("x.l").alias("n_letters"))


@query("select conv_id, turn, trim(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n{3,}', E'\\n\\n', 'g')) as caption from conversations")
def caption_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", texts.sanitise(F.col("text")).alias("caption"))


@query(
    """with w as (select doc_id, unnest(string_split(text, ' ')) as x, generate_subscripts(string_split(text, ' '), 1) as i from documents),
    t as (select doc_id, lower(regexp_replace(x, '[^\\p{L}\\p{N}_]', '', 'g')) as x, min(i) as i from w group by 1, 2 having length(lower(regexp_replace(any_value(x), '[^\\p{L}\\p{N}_]', '', 'g'))) >= 2),
    k as (select *, row_number() over (partition by doc_id order by i) as n from t), j as (select doc_id, string_agg('#' || x, ' ' order by i) as hashtags from k where n <= 4 group by 1)
    select doc_id, hashtags from documents left join j using (doc_id)"""
)
def hashtag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", texts.hashtags(F.split("text", " ")).alias("hashtags"))


@query("select doc_id, case when length(f) <= 500 then f else rtrim(f[1:500]) || '…' end as excerpt from (select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as f from documents)")
def excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", texts.excerpt(F.col("text")).alias("excerpt"))


# What the operator does to the text first, then the four longer forms and cut bodies; every text of the table is in the basic plane.
_CAPTION_SQL = """with t as (select conv_id, turn, 'https://example.com/' || conv_id as link, trim(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', E'\n\n', 'g')) as body from conversations where role = 'assistant'),
    j as (select *, 'News' as h, case when body = '' then '' else E'\n\n' || body end as b, E'\n\nHa!' as ha, E'\n\n' || link as l, E'\n\n#a #b' as tags, case when conv_id % 2 = 0 then E'\n\nTitle ' || conv_id else '' end as ti from t),
    r as (select *, greatest(0, 1000 - length(h || ti || l)) as room from j),
    c as (select *, body[1:greatest(room - 1, 0)] as cut from r),
    k as (select *, length(cut) - length(regexp_extract(cut, '[^ ]*$')) - 1 as space from c),
    s as (select *, case when room <= 1 then '' when length(body) <= room then body else regexp_replace(case when space >= 0 and space > room / 2.0 then cut[1:space] else cut end, '[ \t\n,;:—-]+$', '') || '…' end as short from k)
    select conv_id, turn, case when length(h || ti || b || ha || l || tags) <= 1000 then h || ti || b || ha || l || tags when length(h || ti || b || ha || l) <= 1000 then h || ti || b || ha || l when length(h || ti || b || l) <= 1000 then h || ti || b || l
    when length(h || ti || case when trim(short) = '' then '' else E'\n\n' || trim(short) end || l) <= 1000 then h || ti || case when trim(short) = '' then '' else E'\n\n' || trim(short) end || l
    when length(h || case when trim(short) = '' then '' else E'\n\n' || trim(short) end || l) <= 1000 then h || case when trim(short) = '' then '' else E'\n\n' || trim(short) end || l else link end as caption from s"""


@query(_CAPTION_SQL)
def caption_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    link = F.concat(F.lit("https://example.com/"), F.col("conv_id"))
    title = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("Title "), F.col("conv_id").cast("string")))
    sections = F.array(F.struct(title.alias("title"), texts.sanitise(F.col("text")).alias("body")))
    return turns.select("conv_id", "turn", texts.caption(F.lit("News"), sections, F.lit("Ha!"), link, F.lit("#a #b")).alias("caption"))


_ZONE = "INTERVAL 5 HOUR"


@query(f"select event_id, ts >= date_trunc('day', TIMESTAMP '{NOW}' + {_ZONE}) - {_ZONE} and ts < date_trunc('day', TIMESTAMP '{NOW}' + {_ZONE}) - {_ZONE} + INTERVAL 1 DAY as today, ts >= TIMESTAMP '{NOW}' - INTERVAL 72 HOUR and ts < TIMESTAMP '{NOW}' + INTERVAL 1 HOUR as rolling from events")
def freshness_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, now = F.col("ts").cast("timestamp"), F.lit(NOW).cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", times.is_fresh(at, now, "Asia/Tashkent").alias("today"), times.is_fresh(at, now, "UTC", 72).alias("rolling"))


@query(f"select date_trunc('day', ts + {_ZONE}) - {_ZONE} as day_start, event_type, count(*) as n from events group by 1, 2")
def day_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.window(F.col("ts"), "1 day", None, "19 hours")
    return table(spark, sf_dir, "events").groupBy(day.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("day_start"), "event_type", "n")


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1")
def latest_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.first_by(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query("select source, doc_id, rank from (select source, doc_id, row_number() over (partition by source order by n_chars desc, doc_id)::int as rank from documents) where rank <= 20")
def per_source_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.top_k(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 20).drop("n_chars")


@query(
    """select q.queue, coalesce(c.stuck, 0) as stuck, c.most_attempts, c.oldest from (values ('view'), ('click'), ('purchase'), ('signup'), ('error'), ('idle')) q(queue) left join
    (select event_type as queue, count(*) as stuck, max(user_id % 5) as most_attempts, min(floor(epoch(ts))::bigint) as oldest from events where event_id % 3 <> 0 and floor(epoch(ts))::bigint <= 1705000000 group by 1) c using (queue)"""
)
def queue_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    jobs = table(spark, sf_dir, "events").select(F.col("event_type").alias("queue"), (F.col("user_id") % 5).alias("attempts"), F.when(F.col("event_id") % 3 == 0, 1).alias("reserved_at"), seconds.alias("available_at"))
    queues = spark.createDataFrame([(q,) for q in ("view", "click", "purchase", "signup", "error", "idle")], "queue string")
    return relations.stuck_jobs(jobs, queues, 1705000000)


@query("select source, max(quality) as best from documents join labels using (doc_id) where toxic = 0 group by source")
def max_quality_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").where("toxic = 0"), "doc_id")
    return relations.best_per_group(usable, "source", "quality")


@query(
    """select user_id, arg_min(value, event_id) filter (where value is not null) as value, arg_min(event_type, event_id) as event_type, bool_or(event_type = 'purchase') as featured, min(event_id) as position from events group by user_id"""
)
def fingerprint_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "value", "event_type", (F.col("event_type") == "purchase").alias("featured"), F.col("event_id").alias("position"))
    return relations.merge_first_values(events, "user_id", ["event_id"], ["value", "event_type"], ["featured"], ["position"])


@query("select lang, min(doc_id) as doc_id from documents group by lang")
def distinct_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.distinct_first(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", [F.col("doc_id")])


@query("select doc_id, min(doc_id) over (partition by sha256(text)) as canonical, sha256(text) as content_hash from documents")
def content_hash_dedup_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.by_content(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id", "canonical", "content_hash")


_DISTANCE = "bit_count(xor(('0x' || substr(a.h, 1, 8))::bigint, ('0x' || substr(b.h, 1, 8))::bigint)) + bit_count(xor(('0x' || substr(a.h, 9, 8))::bigint, ('0x' || substr(b.h, 9, 8))::bigint))"


@query(
    f"""with h as (select vec_id, label, substr(sha256(label::varchar), 1, 14) || substr(sha256(vec_id::varchar), 1, 2) as h from embeddings),
    p as (select a.vec_id as id, b.vec_id as match_id, {_DISTANCE} as distance from h a join h b on a.vec_id <> b.vec_id and a.label = b.label)
    select id, arg_min(match_id, (distance, match_id)) as match_id, min(distance)::int as distance, round(1.0 - min(distance) / 16.0, 2) as confidence from p where distance <= 8 group by id"""
)
def hamming_dedup_l3(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    hashed = vectors.select(F.col("vec_id").alias("id"), F.col("label").alias("kind"), F.concat(F.substring(F.sha2(F.col("label").cast("string"), 256), 1, 14), F.substring(F.sha2(F.col("vec_id").cast("string"), 256), 1, 2)).alias("hash"))
    return dedup.nearest_hash(hashed, hashed)


@query(
    """with v as (select vec_id as id, embedding::double[] as v from embeddings union all select vec_id + 1000000, list_transform(embedding::double[], lambda x, i: case when i = 1 + vec_id % 64 then x + 0.2 else x end) from embeddings
    union all select vec_id + 2000000, embedding::double[] from embeddings where vec_id % 10 = 0),
    p as (select a.id, b.id as match_id, round(list_cosine_similarity(a.v, b.v), 6) as similarity from v a join v b on a.id <> b.id)
    select id, arg_min(match_id, (-similarity, match_id)) as match_id, max(similarity) as similarity from p where similarity >= 0.92 group by id"""
)
def embedding_dedup_l4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's vectors, a changed copy of each, and an equal copy of some."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    changed = F.transform("vector", lambda x, i: F.when(i == F.col("id") % 64, x + 0.2).otherwise(x))
    copies = vectors.select((F.col("id") + 1000000).alias("id"), changed.alias("vector")).unionByName(vectors.where("id % 10 = 0").select((F.col("id") + 2000000).alias("id"), "vector"))
    return dedup.nearest_vector(vectors.unionByName(copies))


_SCORES = (
    "least(1.0, round(p_size * 100.0 * (p_size * 60.0) / 2073600, 4)) as resolution, "
    "round(greatest(0.0, 1.0 - abs(ln((p_size * 100.0) / (p_size * 60.0) / 1.91)) / ln(4)), 4) as aspect, "
    "case when p_retailprice * 1000 < 8192 then 0.2 when p_retailprice * 1000 < 3145728 then 1.0 when p_retailprice * 1000 < 10485760 then 0.7 else 0.4 end as fitness"
)


@query(
    f"""select p_partkey, resolution, aspect, visual, relevance, round(least(1.0, 0.25 * relevance + 0.15 * resolution + 0.15 * visual + 0.15 * 0.8 + 0.10 * 1.0 + 0.10 * 0.85 + 0.10 * aspect), 4) as quality
    from (select *, round(0.7 * 0.5 + fitness * 0.5, 4) as visual, round(0.4 * 0.5 + 0.3 * (1.0 - (p_partkey % 5) / 5.0) + 0.3 * 0.6, 4) as relevance from (select p_partkey, {_SCORES} from part))"""
)
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    w, h, kind, size = F.col("p_size") * 100.0, F.col("p_size") * 60.0, F.lit("image"), F.col("p_retailprice") * 1000
    resolution, aspect = scores.resolution(w, h), scores.aspect(kind, w, h)
    visual = scores.visual(F.lit(False), F.lit(None).cast("double"), scores.size_fitness(kind, size), F.lit(False))
    relevance = scores.relevance(F.lit(0.5), scores.position(F.col("p_partkey") % 5, F.lit(5)), scores.trust(F.lit("html_img"), F.lit(False)))
    parts = part.select("p_partkey", resolution.alias("resolution"), aspect.alias("aspect"), visual.alias("visual"), relevance.alias("relevance"))
    unique, ready = scores.uniqueness(F.lit(False), F.lit(1)), F.lit(1.0)
    return parts.withColumn("quality", scores.quality(F.col("relevance"), F.col("resolution"), F.col("visual"), scores.reliability(F.lit(80)), ready, unique, F.col("aspect")))


@query(
    """select p_partkey, case when p_size * 20 <= 2 then 'pixel' when p_name like '%1%' and p_size % 7 = 0 then 'avatar' when p_size % 7 = 1 then 'promo' when p_size % 7 = 2 then 'chrome'
    when p_size * 20 + 10 <= 400 and abs(p_size * 20 / (p_size * 20 + 10.0) - 1) <= 0.12 then 'avatar' else 'content' end as role from part"""
)
def image_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 7
    name = F.when(F.col("p_name").contains("1") & (k == 0), "avatar").when(k == 1, "banner").when(k == 2, "logo").otherwise("photo")
    width = F.col("p_size") * 20
    role = images.role(F.concat(F.lit("https://example.com/i/"), name, F.lit(".jpg")), F.lit(None).cast("string"), width, width + 10)
    return table(spark, sf_dir, "part").select("p_partkey", role.alias("role"))


@query(
    """select p_partkey, case when k = 0 then 'reference' when k = 1 then 'reference' when p_size * 20 < 200 or p_size * 15 < 200 then 'ignore' when k = 2 then 'ignore' when k = 3 then 'reference' else 'download' end as action
    from (select *, p_partkey % 6 as k from part)"""
)
def ingestion_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    url = F.concat(F.lit("https://example.com/a."), F.when(k == 2, "svg").otherwise("jpg"))
    action = scores.ingestion_action(F.when(k == 0, "video").otherwise("image"), F.when(k == 1, "youtube"), F.col("p_size") * 20, F.col("p_size") * 15, url, k != 3)
    return table(spark, sf_dir, "part").select("p_partkey", action.alias("action"))


@query(
    """select day, backlog, greatest(900, least(1800, coalesce(case when k > 0 then floor(k * 20000.0 / (backlog + 1)) end, round(1800 - least(1.0, backlog / 5.0) * 900))))::bigint as ceiling
    from (select cast(o_orderdate as date) as day, count(*) as backlog, extract(day from cast(o_orderdate as date)) % 3 as k from orders group by 1, 3)"""
)
def pacing_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("backlog"))
    seconds = (F.dayofmonth("day") % 3) * 20000
    return days.select("day", "backlog", scores.pacing_ceiling(F.col("backlog"), seconds, 15, 30).alias("ceiling"))


@query(
    """select doc_id, case when x.first_id <> doc_id then 'duplicate_canonical_url' when not regexp_matches(text, '(?i)(?:^|[^\\p{L}\\p{N}_])(?:the|und)(?:$|[^\\p{L}\\p{N}_])') then 'prefilter_not_relevant' when n_chars % 11 = 0 then 'feed_date_not_fresh'
    when text = '' then 'article_unavailable' when q.quality = 0 then 'analysis_not_publishable' end as skip_reason
    from documents d join (select sha256(text) as h, min(doc_id) as first_id from documents group by 1) x on sha256(d.text) = x.h left join labels q using (doc_id)"""
)
def ingest_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup.by_content(table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), "text", "doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    steps = [
        ("duplicate_canonical_url", F.col("is_duplicate")),
        ("prefilter_not_relevant", ~texts.is_on_topic(F.col("text"), ["the", "und"])),
        ("feed_date_not_fresh", F.col("n_chars") % 11 == 0),
        ("article_unavailable", F.col("text") == ""),
        ("analysis_not_publishable", F.col("quality") == 0),
    ]
    return relations.gate(docs, steps).select("doc_id", "skip_reason")


@query(
    """select s_suppkey, case when s_suppkey % 3 = 0 then 'new ' || s_name else s_name end as s_name from supplier union all select s_suppkey + 1000000, 'added' from supplier where s_suppkey % 10 = 0"""
)
def source_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    changed = old.where("s_suppkey % 3 = 0").withColumn("s_name", F.concat(F.lit("new "), "s_name"))
    added = old.where("s_suppkey % 10 = 0").select((F.col("s_suppkey") + 1000000).alias("s_suppkey"), F.lit("added").alias("s_name"))
    return relations.merge(old, changed.unionByName(added), ["s_suppkey"], [F.col("s_name")])


@query("select s_suppkey, s_suppkey % 4 <> 0 as is_active from supplier")
def deactivate_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit(True).alias("is_active"))
    return relations.deactivate_missing(sources, sources.where("s_suppkey % 4 <> 0"), "s_suppkey")


@query("select n_nationkey, r_regionkey from nation cross join region where not (n_regionkey = r_regionkey)")
def ledger_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    ledger = nations.select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    return relations.backfill(nations.select("n_nationkey"), regions.select("r_regionkey"), ledger, ["n_nationkey", "r_regionkey"])


@query("select c_custkey % 5 as channel_id, sha256(c_mktsegment || c_nationkey) as url_hash, min(c_custkey) as c_custkey from customer where not exists (select 1 from nation where n_nationkey = c_nationkey and n_regionkey = 1) group by 1, 2")
def ledger_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = table(spark, sf_dir, "customer").withColumn("url", F.concat("c_mktsegment", F.col("c_nationkey").cast("string")))
    rows = relations.ledger_rows(sent, F.col("c_custkey") % 5, F.col("url"))
    known = rows.join(table(spark, sf_dir, "nation").where("n_regionkey = 1"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    return relations.insert_ignore(rows.select("channel_id", "url_hash", "c_custkey"), known, ["channel_id", "url_hash"], [F.col("c_custkey")])


@query("select a.p_partkey as id, coalesce(b.p_partkey, a.p_partkey) as canonical_id, (select count(*) from part c where c.p_partkey % 4 = 0 and c.p_partkey // 2 = a.p_partkey) as copies from part a left join part b on a.p_partkey % 4 = 0 and b.p_partkey = a.p_partkey // 2")
def canonical_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 == 0, F.floor(F.col("p_partkey") / 2)).alias("duplicate_of_id"))
    return relations.duplicate_counts(relations.canonical(assets)).select("id", "canonical_id", "copies")


def _assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as an article's media: the order is the article, the part the asset. Dealt by article, in partitions whose size doesn't grow."""
    lines = table(spark, sf_dir, "lineitem")
    dealt = lines.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity").repartition(relations.partitions_for(lines), "l_orderkey")
    lines = relations.first_by(dealt, ["l_orderkey", "l_partkey"], [F.col("l_linenumber"), F.col("l_quantity")])
    kind = F.when(F.col("l_partkey") % 10 == 0, "video").otherwise("image")
    return lines.select(F.col("l_orderkey").alias("news_id"), F.col("l_partkey").alias("asset_id"), F.col("l_linenumber").alias("position"), F.round(F.col("l_quantity") / 50, 4).alias("score"), kind.alias("type"), (F.col("l_partkey") % 20 == 0).alias("native"), F.concat(F.lit("https://example.com/"), F.col("l_partkey").cast("string")).alias("url"))


@query(
    """with one as (select *, row_number() over (partition by l_orderkey, l_partkey order by l_linenumber, l_quantity) as k from lineitem),
    a as (select l_orderkey as news_id, l_partkey as asset_id, l_linenumber as position, round(l_quantity / 50, 4) as score, l_partkey % 10 = 0 as is_video from one where k = 1),
    r as (select *, row_number() over (partition by news_id order by score desc, position, asset_id) as rank from a where score >= 0.35),
    p as (select news_id, list(asset_id order by rank) filter (where not is_video) as ids, count(*) filter (where not is_video) as n, arg_min(asset_id, rank) filter (where is_video) as v from r group by news_id),
    q as (select *, case when v % 20 = 0 then 'video' when v is not null and n > 0 then 'video_thumbnail_fallback' when v is not null or n = 0 then 'none' when n = 1 then 'single_image' else 'media_group' end as plan from p)
    select news_id, plan, array_to_string(case plan when 'video' then [v] when 'none' then [] when 'media_group' then ids[1:4] else ids[1:1] end, ',') as assets, case when plan = 'video_thumbnail_fallback' then 'https://example.com/' || v end as link from q"""
)
def post_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = selection.with_visual_rank(selection.rank_assets(_assets(spark, sf_dir).where("score >= 0.35")))
    return selection.post_plans(ranked).select("news_id", "plan", F.array_join(F.transform("asset_ids", lambda x: x.cast("string")), ",").alias("assets"), "link")


# All assets with one key are one picture here, so that pictures are numbered by their first rank.
@query(
    """with one as (select *, row_number() over (partition by l_orderkey, l_partkey order by l_linenumber, l_quantity) as k from lineitem),
    r as (select l_orderkey as news_id, l_partkey as asset_id, row_number() over (partition by l_orderkey order by round(l_quantity / 50, 4) desc, l_linenumber, l_partkey)::int as rank from one where k = 1),
    g as (select news_id, asset_id % 4 as part, row_number() over (partition by news_id order by min(rank)) - 1 as picture from r group by 1, 2)
    select r.news_id, r.asset_id, r.rank, g.picture::int as picture from r join g on g.news_id = r.news_id and g.part = r.asset_id % 4"""
)
def rendition_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = selection.rank_assets(_assets(spark, sf_dir))
    key = F.concat(F.lit("url:example.com|picture-of-part-"), (F.col("asset_id") % 4).cast("string"))
    needed = ranked.select("news_id", "asset_id", "rank", F.array(key).alias("keys"))
    grouped = selection.group_renditions(needed, partitions=relations.partitions_for(table(spark, sf_dir, "lineitem")))
    return grouped.select("news_id", "asset_id", "rank", F.col("picture").cast("int").alias("picture"))


@query(
    """select page_id, yt, case when yt is not null then 'https://www.youtube.com/watch?v=' || yt else u end as watch from (select page_id, u, case when k = 0 then 'v' || page_id when k = 1 then 's' || page_id when k = 2 then 'e' || page_id end as yt
    from (select page_id, page_id % 4 as k, case page_id % 4 when 0 then 'https://www.youtube.com/watch?v=v' || page_id || '&t=1' when 1 then 'https://youtu.be/s' || page_id when 2 then 'https://www.youtube-nocookie.com/embed/e' || page_id else url end as u from pages))"""
)
def youtube(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, at = F.col("page_id") % 4, F.col("page_id").cast("string")
    url = F.when(k == 0, F.concat(F.lit("https://www.youtube.com/watch?v=v"), at, F.lit("&t=1"))).when(k == 1, F.concat(F.lit("https://youtu.be/s"), at)).when(k == 2, F.concat(F.lit("https://www.youtube-nocookie.com/embed/e"), at)).otherwise(F.col("url"))
    found = table(spark, sf_dir, "pages").select("page_id", url.alias("u")).withColumn("yt", urls.youtube_id(F.col("u")))
    return found.select("page_id", "yt", F.coalesce(urls.youtube_watch_url(F.col("yt")), "u").alias("watch"))


@query(
    """select event_id, case when k is null or k >= 500 then 'delivery_unknown' when k = 429 then 'retry_later' when k = 400 then 'media_rejected' when k = 403 then 'failed' when event_id % 7 = 0 then 'invalid_receipt' else 'sent' end as outcome,
    k is null or k in (408, 425, 429) or k >= 500 as retryable from (select event_id, case event_id % 6 when 0 then null when 1 then 500 when 2 then 429 when 3 then 400 when 4 then 403 else 200 end as k from events)"""
)
def send_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 6
    status = F.when(k == 1, 500).when(k == 2, 429).when(k == 3, 400).when(k == 4, 403).when(k == 5, 200)
    text = F.when(k == 3, "Bad Request: wrong file identifier").otherwise("Forbidden")
    outcome = scores.send_outcome(status == 200, status, text, F.lit(None).cast("int"), F.when(F.col("event_id") % 7 != 0, F.col("event_id")))
    return table(spark, sf_dir, "events").select("event_id", outcome.alias("outcome"), scores.is_retryable(status).alias("retryable"))


@query("select page_id, 'media/2024/01/original/' || sha256(html) || '.html' as storage_key, case when page_id % 3 = 0 then html else replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') end as head from pages")
def storage_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = times.storage_key("original", F.lit(NOW).cast("timestamp"), F.sha2("html", 256), F.lit("html"))
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", key.alias("storage_key"), F.when(F.col("page_id") % 3 == 0, html).otherwise(texts.escape(html)).alias("head"))


@query("select doc_id, lpad((1 + doc_id % 28)::varchar, 2, '0') || ' ' || ['Jan','Feb','Mar'][1 + (doc_id % 3)::int] || ' 2023' as stated, make_timestamp(2023, 1 + doc_id % 3, 1 + doc_id % 28, 0, 0, 0.0) as published from documents where doc_id % 5 <> 0 union all select doc_id, 'Sep 10', null from documents where doc_id % 5 = 0")
def publish_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, month = F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.element_at(F.array(*map(F.lit, ("Jan", "Feb", "Mar"))), (F.col("doc_id") % 3 + 1).cast("int"))
    stated = F.when(F.col("doc_id") % 5 == 0, "Sep 10").otherwise(F.concat(day, F.lit(" "), month, F.lit(" 2023")))
    published = times.parse_date(F.col("stated"), F.lit(NOW).cast("timestamp"))
    return table(spark, sf_dir, "documents").select("doc_id", stated.alias("stated")).select("doc_id", "stated", published.cast("timestamp_ntz").alias("published"))


@query(
    "select event_id, ts + INTERVAL 18000 SECOND as shifted, replace(coalesce(props, ''), '120', '30') as props from events"
)
def time_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = relations.shift_times(table(spark, sf_dir, "events").withColumn("shifted", F.col("ts")), ["shifted"], 18000)
    return shifted.select("event_id", "shifted", F.replace(F.coalesce("props", F.lit("")), F.lit("120"), F.lit("30")).alias("props"))


@query(
    """select news_id, asset_id, origin from (select *, row_number() over (partition by news_id, asset_id order by origin, position) as n from (
    select l_orderkey as news_id, l_partkey as asset_id, 0 as origin, l_linenumber as position from lineitem union all
    select l_orderkey, l_suppkey, 1, l_linenumber from lineitem)) where n = 1"""
)
def media_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    article = lines.select(F.col("l_orderkey").alias("news_id"), F.col("l_partkey").alias("asset_id"), F.col("l_linenumber").alias("position"), F.lit(0).alias("origin"))
    event = lines.select(F.col("l_orderkey").alias("news_id"), F.col("l_suppkey").alias("asset_id"), F.col("l_linenumber").alias("position"), F.lit(1).alias("origin"))
    return relations.pool(article, event).select("news_id", "asset_id", "origin")


@query("""select event_id, coalesce(json_extract_string(props, '$.k')::int, 4) as k, case when json_extract_string(props, '$.k') = '69' then '{"k": 30}' else props end as props from events""")
def json_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.coalesce(records.at_path(F.col("props"), "k").try_cast("int"), F.lit(settings.CHANNEL_RULES["max_images"]))
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), records.with_rule(F.col("props"), "k", 69, 30).alias("props"))


_FRESH = f"(TIMESTAMP '{NOW}' - INTERVAL 72 HOUR)", f"(TIMESTAMP '{NOW}' + INTERVAL 1 HOUR)"
_ARTICLES_SQL = f"""a as (select o_orderkey as news_id, 'example.com/' || (o_orderkey % 700) as canonical_url, TIMESTAMP '{NOW}' - o_orderkey % 97 * INTERVAL 1 HOUR as published_at,
    case when o_orderkey % 11 = 0 then 1 end as started_at, case when o_orderkey % 13 = 0 then 1 end as sent_at, case when o_orderkey % 7 <> 0 then 1 end as analysed_at, case when o_orderkey % 5 = 0 then 1 end as queued_at from orders),
    ledger as (select distinct c_custkey % 6 as channel_id, 'example.com/' || (c_custkey % 350) as canonical_url from customer)"""


def _articles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as articles, customers as the ledger of what channels have sent."""
    k = F.col("o_orderkey")
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(NOW).cast("timestamp")) - k % 97 * 3600)
    when = lambda condition: F.when(condition, 1)
    articles = table(spark, sf_dir, "orders").select(
        k.alias("news_id"), F.concat(F.lit("example.com/"), (k % 700).cast("string")).alias("canonical_url"), at.alias("published_at"), when(k % 11 == 0).alias("started_at"),
        when(k % 13 == 0).alias("sent_at"), when(k % 7 != 0).alias("analysed_at"), when(k % 5 == 0).alias("queued_at"),
    )
    ledger = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 6).alias("channel_id"), F.concat(F.lit("example.com/"), (F.col("c_custkey") % 350).cast("string")).alias("canonical_url"))
    return articles, ledger


@query(
    f"""with {_ARTICLES_SQL}, s as (select o_custkey % 8 as channel_id, o_orderkey + case when o_orderkey % 17 = 0 then 1000000000 else 0 end as news_id from orders)
    select s.channel_id, s.news_id, case when s.channel_id > 5 or s.channel_id = 2 then 'channel_inactive' when l.channel_id is not null then 'already_sent_to_channel' when a.news_id is null then 'news_item_missing'
    when not (a.published_at >= {_FRESH[0]} and a.published_at < {_FRESH[1]}) then 'not_fresh_at_send_time' when started_at is not null or sent_at is not null then 'already_claimed_or_published' end as skip_reason
    from s left join a using (news_id) left join ledger l on l.channel_id = s.channel_id and l.canonical_url = a.canonical_url"""
)
def publish_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles, ledger = _articles(spark, sf_dir)
    k = F.col("o_orderkey")
    sends = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 8).alias("channel_id"), F.when(k % 17 == 0, k + 1000000000).otherwise(k).alias("news_id"))
    channels = spark.range(6).select(F.col("id").alias("channel_id"), (F.col("id") != 2).alias("is_active"))
    return publishing.guard(sends, channels, articles, ledger, *times.window_bounds(F.lit(NOW).cast("timestamp"), "UTC", 72))


@query(
    f"""with {_ARTICLES_SQL} select news_id, canonical_url from a where analysed_at is not null and queued_at is null and sent_at is null and published_at >= {_FRESH[0]} and published_at < {_FRESH[1]}
    and not exists (select 1 from ledger l where l.channel_id = 3 and l.canonical_url = a.canonical_url)"""
)
def scheduler_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles, ledger = _articles(spark, sf_dir)
    return publishing.eligible(articles, ledger, F.lit(3), *times.window_bounds(F.lit(NOW).cast("timestamp"), "UTC", 72)).select("news_id", "canonical_url")


@query(
    """select event_id, id, row_number() over (partition by id order by ts, event_id) = 1 and exists (select 1 from part where p_partkey = id and p_partkey % 3 <> 0) as won from (select event_id, ts, user_id * 2 as id from events)"""
)
def claim_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, 1).alias("queued_at"))
    bids = table(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") * 2).alias("id"))
    return publishing.claim(rows, bids, "id", "queued_at", [F.col("ts"), F.col("event_id")]).select("event_id", "id", "won")


@query(
    """with o as (select s_suppkey, case when s_suppkey % 9 = 0 then 'soon' when s_suppkey % 4 = 0 then null else (s_suppkey % 41 - 2)::varchar end as a, case when s_suppkey % 5 = 0 then null else (s_suppkey % 37)::varchar end as b, case when s_suppkey % 3 = 0 then (s_suppkey % 13 / 10.0)::varchar end as p from supplier),
    n as (select *, try_cast(a as int) as x, try_cast(b as int) as y, try_cast(p as double) as z from o),
    e as (select *, case when a is not null and coalesce(x < 1, true) then 'min-interval must be a whole number of minutes, at least 1' when b is not null and coalesce(y < 1, true) then 'max-interval must be a whole number of minutes, at least 1'
    when p is not null and not coalesce(z between 0 and 1, false) then 'min-priority must be between 0 and 1' when coalesce(x, 15) > coalesce(y, 30) then 'min-interval cannot exceed max-interval' end as error from n)
    select s_suppkey, case when error is null then coalesce(x, 15) else 15 end as min_minutes, case when error is null then coalesce(y, 30) else 30 end as max_minutes, case when error is null then coalesce(z, 0.2) else 0.2 end::double as min_priority, error from e"""
)
def cadence_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    low = F.when(k % 9 == 0, "soon").when(k % 4 != 0, (k % 41 - 2).cast("string"))
    high = F.when(k % 5 != 0, (k % 37).cast("string"))
    share = F.when(k % 3 == 0, (k % 13 / 10.0).cast("string"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", publishing.cadence(F.lit("{}"), low, high, share).alias("c")).select("s_suppkey", "c.*")


@query("select p_partkey as asset_id, case when p_partkey % 3 = 0 then 'https://cdn.example.com/v/' || p_partkey when p_partkey % 2 = 0 then 'https://cdn.example.com/o/' || p_partkey else 'https://example.com/' || p_partkey end as send_url from part")
def send_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    assets = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asset_id"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("o/"), k)).alias("storage_path"), F.concat(F.lit("https://example.com/"), k).alias("original_url"))
    made = table(spark, sf_dir, "part").where("p_partkey % 3 = 0")
    variants = made.select(F.col("p_partkey").alias("asset_id"), F.lit("telegram").alias("variant_type"), F.concat(F.lit("v/"), k).alias("storage_path"))
    variants = variants.unionByName(made.select(F.col("p_partkey").alias("asset_id"), F.lit("thumbnail").alias("variant_type"), F.concat(F.lit("t/"), k).alias("storage_path")))
    return publishing.send_urls(assets, variants, "https://cdn.example.com").select("asset_id", "send_url")


@query(
    """with a as (select p_partkey as asset_id, p_size * 100 as w, p_size * 60 as h from part where p_partkey % 2 = 0), k(variant_type, most) as (values ('telegram', 1280), ('thumbnail', 320), ('original', null))
    select asset_id, variant_type, (case when most is null then w when variant_type = 'thumbnail' then 320 else round(w * least(1.0, most / w::double)) end)::int as width, (case when most is null then h when variant_type = 'thumbnail' then 320 else round(h * least(1.0, most / w::double)) end)::int as height
    from a cross join k where not (variant_type = 'telegram' and asset_id % 3 = 0)"""
)
def variants_to_make(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    assets = part.select(F.col("p_partkey").alias("asset_id"), F.when(F.col("p_partkey") % 2 == 0, "stored").alias("storage_path"), (F.col("p_size") * 100).alias("width"), (F.col("p_size") * 60).alias("height"))
    made = part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("asset_id"), F.lit("telegram").alias("variant_type"))
    return ingestion.missing_variants(assets, made, ["telegram", "thumbnail", "original"])


@query(
    f"""with s as (select distinct 'u' || (doc_id % 900) as canonical_url from documents where doc_id % 50 = 0),
    c as (select doc_id, 'u' || (doc_id % 900) as u, left(text, 200) as t, doc_id % 4 = 0 as skip, case when doc_id % 3 = 0 then TIMESTAMP '{NOW}' - doc_id % 80 * INTERVAL 1 HOUR end as fd, doc_id % 6 = 0 as gone, doc_id % 12 = 0 as use_feed, doc_id % 24 = 0 as empty_summary,
        case when doc_id % 5 <> 0 then TIMESTAMP '{NOW}' - doc_id % 90 * INTERVAL 1 HOUR end as pd, doc_id % 19 = 0 as untitled, doc_id % 8 <> 1 as publish from documents),
    r as (select *, case when exists (select 1 from s where s.canonical_url = u) then 'duplicate_canonical_url' when not skip and trim(t) <> '' and not regexp_matches(t, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(?:the|der|de)(?:$|[^\\p{{L}}\\p{{N}}_])') then 'prefilter_not_relevant'
        when fd is not null and not (fd >= {_FRESH[0]} and fd < {_FRESH[1]}) then 'feed_date_not_fresh' when gone and (not use_feed or empty_summary) then 'article_unavailable'
        when not coalesce(coalesce(pd, fd) >= {_FRESH[0]} and coalesce(pd, fd) < {_FRESH[1]}, false) then 'parsed_date_not_fresh' when untitled then 'analysis_missing_title' when not publish then 'analysis_not_publishable' end as reason from c)
    select doc_id as candidate_id, case when reason is null and row_number() over (partition by u, reason is null order by doc_id) > 1 then 'duplicate_race' else reason end as skip_reason from r"""
)
def ingest_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, k, now = table(spark, sf_dir, "documents"), F.col("doc_id"), F.lit(NOW).cast("timestamp")
    url = F.concat(F.lit("u"), (k % 900).cast("string"))
    ago = lambda hours: F.timestamp_seconds(F.unix_timestamp(now) - hours * 3600)
    candidates = docs.select(
        k.alias("candidate_id"), url.alias("canonical_url"), F.left("text", F.lit(200)).alias("prefilter_text"), (k % 4 == 0).alias("skip_prefilter"), F.when(k % 3 == 0, ago(k % 80)).alias("feed_date"),
        F.when(k % 6 != 0, "<p>").alias("html"), F.when(k % 24 == 0, " ").otherwise("s").alias("summary"), (k % 12 == 0).alias("use_feed_content"), F.when(k % 5 != 0, ago(k % 90)).alias("parsed_date"),
        F.when(k % 19 != 0, "T").alias("title"), (k % 8 != 1).alias("publish"),
    )
    stored = docs.where("doc_id % 50 = 0").select(url.alias("canonical_url"))
    found = ingestion.ingest(candidates, stored, *times.window_bounds(now, "UTC", 72), keywords=["the", "der", "de"])
    return found.select("candidate_id", "skip_reason")


@query(
    """with m as (select l_orderkey as news_id, case when l_partkey % 10 = 0 then 'rejected_avatar' when l_partkey % 10 = 1 then 'rejected_chrome' when l_partkey % 10 < 4 then 'existing' when l_quantity < 5 then 'ignored' when l_partkey % 10 = 4 then 'created_video' when l_partkey % 2 = 0 then 'created_download' else 'created_ready' end as o from lineitem)
    select news_id, count(*) as candidates, count(*) filter (where o = 'existing') as existing, count(*) filter (where o like 'created%') as created, count(*) filter (where o like 'rejected%' or o = 'ignored') as ignored, count(*) filter (where o = 'created_ready') as ready_references,
    count(*) filter (where o in ('created_download', 'created_video')) as follow_ups, concat_ws(',', case when count(*) filter (where o = 'rejected_avatar') > 0 then 'avatar:' || count(*) filter (where o = 'rejected_avatar') end, case when count(*) filter (where o = 'rejected_chrome') > 0 then 'chrome:' || count(*) filter (where o = 'rejected_chrome') end) as rejected_roles
    from m group by 1"""
)
def extraction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey") % 10
    role = F.when(k == 0, "avatar").when(k == 1, "chrome").otherwise("content")
    action = F.when(F.col("l_quantity") < 5, "ignore").when(k == 4, "reference").when(k % 2 == 0, "download").otherwise("reference")
    kind = F.when(k == 4, "video").otherwise("image")
    outcome = ingestion.media_outcome(role, k < 2, (k == 2) | (k == 3), action, kind)
    counts = ingestion.outcome_counts(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("news_id"), outcome.alias("outcome")))
    return counts.withColumn("rejected_roles", F.array_join("rejected_roles", ","))


@query("select source as feed, count(*) as candidates, count(*) filter (where doc_id % 7 = 0) as without_date from documents group by 1")
def feed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingestion.feed_counts(table(spark, sf_dir, "documents").select(F.col("source").alias("feed"), F.when(F.col("doc_id") % 7 != 0, "2024-01-01").alias("published")))


@query("select l_orderkey as news_id, count(*) as assets, count(*) filter (where l_partkey % 3 <> 0) as usable from lineitem group by 1")
def asset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("l_partkey") % 3 == 0, "failed").when(F.col("l_partkey") % 3 == 1, "ready").otherwise("published")
    return ingestion.asset_counts(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("news_id"), status.alias("status")))


@query("select p_partkey as asset_id, greatest(case when p_partkey % 4 = 0 then null else p_size / 50.0 end, m)::double as score from part left join (select l_partkey, max(round(l_quantity / 100, 4)) as m from lineitem group by 1) on l_partkey = p_partkey")
def running_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asset_id"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_size") / 50.0).alias("score"))
    attached = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("asset_id"), F.round(F.col("l_quantity") / 100, 4).alias("score"))
    return ingestion.with_running_max(assets, attached)


@query(
    """with one as (select *, row_number() over (partition by l_orderkey, l_partkey order by l_linenumber, l_quantity) as k from lineitem),
    t as (select l_orderkey as news_id, l_partkey as asset_id, round(l_quantity / 50, 4) as score, row_number() over (partition by l_orderkey order by round(l_quantity / 50, 4) desc, l_partkey)::int as vision_rank from one where k = 1 and round(l_quantity / 50, 4) >= 0.35)
    select news_id, asset_id, vision_rank, round(0.4 * score + 0.6 * case when asset_id % 3 = 0 then score else (asset_id % 101) / 100.0 end, 4) as score, asset_id % 5 <> 0 and asset_id % 7 <> 0 and asset_id % 11 <> 0 as readable from t where vision_rank <= 3"""
)
def vision_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = ingestion.vision_candidates(_assets(spark, sf_dir).select("news_id", "asset_id", "score"))
    k = F.col("asset_id")
    replies = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asset_id"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey") % 101).alias("reply"))
    readable = ingestion.readable_by_vision(F.when(k % 5 == 0, "video").otherwise("image"), F.when(k % 7 != 0, "x"), F.when(k % 11 == 0, 5_000_000), F.lit(None).cast("string"))
    return ingestion.vision_rescored(chosen, replies).select("news_id", "asset_id", "vision_rank", "score", readable.alias("readable"))


@query(
    """with one as (select *, row_number() over (partition by l_orderkey, l_partkey order by l_linenumber, l_quantity) as k from lineitem),
    r as (select l_orderkey as news_id, l_partkey as asset_id, row_number() over (partition by l_orderkey order by round(l_quantity / 50, 4) desc, l_linenumber, l_partkey)::int as rank from one where k = 1) select * from r where rank <= 2 and asset_id % 10 <> 0"""
)
def fingerprint_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingestion.fingerprint_candidates(selection.rank_assets(_assets(spark, sf_dir)), 2).select("news_id", "asset_id", "rank")


@query(
    f"""with h as (select vec_id as id, label as kind, substr(sha256(label::varchar), 1, 14) || substr(sha256(vec_id::varchar), 1, 2) as h, vec_id % 60 as days, vec_id % 5 = 0 as copy from embeddings),
    p as (select a.id, b.id as match_id, {_DISTANCE} as distance from h a join h b on a.id <> b.id and a.kind = b.kind where a.kind < 7 and b.days <= 30 and not b.copy)
    select id, arg_min(match_id, (distance, match_id)) as match_id, min(distance)::int as distance, round(1.0 - min(distance) / 16.0, 2) as confidence from p where distance <= 8 group by id"""
)
def hamming_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(NOW).cast("timestamp")
    v, label = F.col("vec_id"), F.col("label").cast("string")
    digits = F.concat(F.substring(F.sha2(label, 256), 1, 14), F.substring(F.sha2(v.cast("string"), 256), 1, 2))
    assets = table(spark, sf_dir, "embeddings").select(v.alias("id"), label.alias("kind"), digits.alias("hash"), F.when(v % 5 == 0, v - 1).alias("duplicate_of_id"), F.timestamp_seconds(F.unix_timestamp(now) - v % 60 * 86400).alias("created_at"))
    return dedup.nearest_known_hash(assets.select("id", "kind", "hash"), assets, now, kinds=[str(k) for k in range(7)])


@query("select p_partkey, s_suppkey as source_id, s_name as source_name from part left join supplier on s_suppkey = p_partkey % 130")
def asset_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("id_of"), F.col("s_name").alias("name"))
    found = ingestion.with_source(table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 130).alias("source_id")), sources)
    return found.select("p_partkey", F.col("source_id_of").alias("source_id"), "source_name")


@query(
    """select 'p' || (p_partkey % 400) as fingerprint, min(p_partkey) as position, bool_or(p_size % 9 = 0) as featured, arg_min(p_brand, p_partkey) filter (where p_size % 2 = 0) as caption,
    arg_min('a' || p_partkey, p_partkey) as a, arg_min('b' || p_partkey, p_partkey) filter (where p_size % 3 = 0) as b from part group by 1"""
)
def extracted_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = lambda x: F.concat(F.lit(x), k.cast("string"))
    extra = F.when(F.col("p_size") % 3 == 0, F.create_map(F.lit("a"), name("a"), F.lit("b"), name("b"))).otherwise(F.create_map(F.lit("a"), name("a")))
    media = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), (k % 400).cast("string")).alias("fingerprint"), k.alias("position"), (F.col("p_size") % 9 == 0).alias("featured"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("caption"), extra.alias("extra"))
    return ingestion.merge_extracted(media, "fingerprint", ["position"], ["caption"], "extra").select("fingerprint", "position", "featured", "caption", F.col("extra")["a"].alias("a"), F.col("extra")["b"].alias("b"))
