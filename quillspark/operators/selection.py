"""Choice of an article's media: rank, group renditions, plan a post."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark import settings
from quillspark.functions import images, urls
from quillspark.operators.relations import first_by

_SEPARATORS = frozenset("-_./|")


def same_picture(a: str, b: str, threshold: int = settings.HAMMING_THRESHOLD) -> bool:
    """Whether two identity keys mean one picture: equal, near perceptual hashes, or a name cut short."""
    if a == b:
        return True
    kinds = a.partition(":")[0], b.partition(":")[0]
    if kinds == ("phash", "phash"):
        x, y = a[6:], b[6:]
        if len(x) != 16 or len(y) != 16:
            return False
        ones = [int(h, 16).bit_count() for h in (x, y)]
        return all(min(n, 64 - n) >= 6 for n in ones) and (int(x, 16) ^ int(y, 16)).bit_count() <= threshold
    if kinds != ("url", "url"):
        return False
    short, long = sorted((a, b), key=len)
    if not long.startswith(short) or len(short) - 4 < settings.MIN_TRUNCATION or len(long) == len(short):
        return False
    return long[len(short)] not in _SEPARATORS and short[-1] not in _SEPARATORS


def _groups_of(keys_of: list[list[str]]) -> list[int]:
    """For each asset, in order, the number of the first group that any of its keys matches."""
    groups: list[list[str]] = []
    known: dict[str, int] = {}
    numbers = []
    for own in keys_of:
        equal = min((known[x] for x in own if x in known), default=len(groups))
        # an earlier group may match by nearness; from the equal one on nothing earlier can
        hit = next((k for k in range(equal) if any(same_picture(a, b) for a in groups[k] for b in own)), equal)
        if hit == len(groups):
            groups.append([])
        groups[hit] += [x for x in own if x not in groups[hit]]
        for x in own:
            known[x] = min(hit, known.get(x, hit))
        numbers.append(hit)
    return numbers


def group_renditions(ranked: DataFrame, article: str = "news_id", keys: str = "keys", rank: str = "rank", partitions: int | None = None) -> DataFrame:
    """Adds ``picture`` to an article's ranked assets: the number of the first group that any key matches.

    The fold depends on the order and never joins two groups, so the assets of an
    article (a few dozen) are folded together, whole batches of articles at a time.
    A task sorts its rows twice, with all columns: give those that are needed, and a
    number of partitions that grows with the table.
    """
    schema = ranked.withColumn("picture", F.lit(0)).schema
    at = [ranked.columns.index(c) for c in (article, keys)]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def numbered(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            articles, own = rows.column(at[0]).to_pylist(), rows.column(at[1]).to_pylist()
            numbers: list[int] = []
            for _, group in itertools.groupby(range(len(articles)), key=articles.__getitem__):
                numbers += _groups_of([list(own[k] or ()) for k in group])
            yield from rows.append_column("picture", pa.array(numbers, pa.int32())).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            articles = rows.column(at[0]).to_pylist()
            cut = next((k + 1 for k in range(len(articles) - 2, -1, -1) if articles[k] != articles[-1]), 0)
            held = rows.slice(cut)
            if cut:
                yield from numbered(rows.slice(0, cut))
        if held is not None:
            yield from numbered(held)

    dealt = ranked.repartition(partitions, article) if partitions else ranked.repartition(article)
    return dealt.sortWithinPartitions(article, rank).mapInArrow(fold, schema)


def rank_assets(assets: DataFrame, score: str = "score", article: str = "news_id", rank: str = "rank") -> DataFrame:
    """Numbers an article's assets by score; equal ones keep their position."""
    return assets.withColumn(rank, F.row_number().over(Window.partitionBy(article).orderBy(F.desc(score), F.col("position").asc_nulls_last(), "asset_id")))


def usable(assets: DataFrame, min_quality: float = settings.CHANNEL_RULES["min_quality_score"]) -> DataFrame:
    """Assets that may be posted: ready, no copies, of a known format, content images, good enough."""
    visual = F.col("type").isin(settings.VISUAL_TYPES)
    content = images.role(F.col("url"), F.col("alt"), F.col("width"), F.col("height")) == "content"
    fit = F.col("status").isin("ready", "published") & F.col("duplicate_of_id").isNull() & ~urls.extension(F.col("url")).isin(settings.UNPUBLISHABLE_FORMATS)
    return assets.where(fit & (~visual | content) & (F.col("score") >= min_quality) & ~(visual & images.unusable_dimensions(F.col("width"), F.col("height"))))


def distinct_pictures(grouped: DataFrame, groups: int = 12, requests: int = 24, article: str = "news_id") -> DataFrame:
    """Assets of an article's first groups, so many at most, that are worth a closer look."""
    near = grouped.where(F.col("picture") < groups)
    return near.withColumn("_n", F.row_number().over(Window.partitionBy(article).orderBy("picture", "rank"))).where(F.col("_n") <= requests).drop("_n")


def keepers(grouped: DataFrame, article: str = "news_id") -> DataFrame:
    """The best of each picture."""
    return first_by(grouped, [article, "picture"], [F.col("rank")])


def resolved_duplicates(grouped: DataFrame, article: str = "news_id") -> DataFrame:
    """(asset_id, duplicate_of_id) of copies that pixels prove, whose asset has no copies of its own."""
    best = keepers(grouped, article).select(article, "picture", F.col("asset_id").alias("keeper"), F.col("phash").alias("keeper_phash"))
    proven = F.col("phash").isNotNull() & F.col("keeper_phash").isNotNull() & F.col("duplicate_of_id").isNull() & (F.coalesce("copies", F.lit(0)) == 0)
    return grouped.join(best, [article, "picture"]).where((F.col("asset_id") != F.col("keeper")) & proven).select("asset_id", F.col("keeper").alias("duplicate_of_id")).distinct()


def curated(ranked: DataFrame, reply: DataFrame, judged: int = 8, article: str = "news_id") -> DataFrame:
    """Applies a model's ranking of the first assets (news_id, ranked, redundant: places from 0).

    The ranked ones come first, one of each redundant set, then those that weren't shown.
    """
    place = F.col("rank") - 1
    joined = ranked.join(reply, article, "left")
    shown = place < judged
    at = F.array_position("ranked", place.cast("int"))
    # of each redundant set, the member that the model ranks best stays
    own_sets = F.filter("redundant", lambda s: F.array_contains(s, place.cast("int")))
    best = lambda s: F.array_min(F.transform(F.filter(s, lambda x: F.array_contains("ranked", x)), lambda x: F.array_position("ranked", x)))
    beaten = F.coalesce(F.exists(own_sets, lambda s: best(s) < at), F.lit(False))
    kept = joined.where(~shown | F.col("ranked").isNull() | ((at > 0) & ~beaten))
    order = Window.partitionBy(article).orderBy(F.when(shown & F.col("ranked").isNotNull(), at).otherwise(F.lit(10_000) + F.col("rank")))
    return kept.withColumn("rank", F.row_number().over(order)).drop("ranked", "redundant")


def post_plans(ranked: DataFrame, max_images: int = 4, prefer_video: bool = True, allow_group: bool = True, article: str = "news_id") -> DataFrame:
    """One plan for each article: none, single_image, media_group, video, or video_thumbnail_fallback with a link."""
    size = min(max_images, settings.MAX_GROUP)
    visual = F.col("type").isin(settings.VISUAL_TYPES)
    one = F.struct("rank", "asset_id")
    found = ranked.groupBy(article).agg(
        F.array_sort(F.collect_list(F.when(visual & (F.col("rank_visual") <= max(1, size)), one))).alias("visuals"),
        F.count_if(visual).alias("n_visual"),
        F.min_by(F.struct("asset_id", "url", "native"), F.when(F.col("type") == "video", F.col("rank"))).alias("video"),
    )
    ids = F.transform("visuals", lambda x: x["asset_id"])
    video = F.col("video").isNotNull() & F.lit(prefer_video)
    native = F.coalesce(F.col("video.native"), F.lit(False))
    kind = (
        F.when(video & native, "video").when(video & (F.col("n_visual") > 0), "video_thumbnail_fallback").when(video, "none").when(F.col("n_visual") == 0, "none")
        .when((F.col("n_visual") == 1) | F.lit(not allow_group or size < 2), "single_image").otherwise("media_group")
    )
    planned = found.withColumn("plan", kind)
    chosen = F.when(F.col("plan") == "video", F.array("video.asset_id")).when(F.col("plan").isin("single_image", "video_thumbnail_fallback"), F.slice(ids, 1, 1)).when(F.col("plan") == "media_group", F.slice(ids, 1, max(1, size))).otherwise(F.slice(ids, 1, 0))
    return planned.select(article, "plan", chosen.alias("asset_ids"), F.when(F.col("plan") == "video_thumbnail_fallback", F.col("video.url")).alias("link"))


def with_visual_rank(ranked: DataFrame, article: str = "news_id") -> DataFrame:
    visual = F.col("type").isin(settings.VISUAL_TYPES)
    return ranked.withColumn("rank_visual", F.sum(F.when(visual, 1).otherwise(0)).over(Window.partitionBy(article).orderBy("rank")))


def send_ladder(plan: str = "plan") -> F.Column:
    """The ways in which a plan is sent, each tried where the one before was refused."""
    steps = lambda *xs: F.array(*map(F.lit, xs))
    return F.when(F.col(plan) == "media_group", steps("album", "photo", "text")).when(F.col(plan) == "video", steps("video", "text")).when(F.col(plan) == "none", steps("text")).otherwise(steps("photo", "text"))
