"""One query per operator. Lists are returned as joined texts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tagloom import constants as C
from tagloom.functions import labels as L
from tagloom.functions import prompts as P
from tagloom.functions.features import (
    aspect_ratio_token,
    coarse_rating,
    exact_rating,
    fuzzy_rating,
    length_token,
)
from tagloom.functions.text import has_text, iso_year, split_tags, tag_count, tokenize
from tagloom.operators import clean, compose, organize, stats, vectors
from tagloom.operators import summary as totals
from tagloom.operators.encode import decode, decoder, unknown_tags
from tagloom.operators.kmeans import fit_clusters
from tagloom.operators.requests import Made
from tagloom.operators.select import select_where
from tagloom.operators.similar import similar_tags_pruned
from tagloom.operators.split import head, train_test_split
from tagloom.operators.vocabulary import (
    VocabularyParams,
    build_vocabulary,
    duplicate_tokens,
    most_frequent_first,
    popular,
    tag_counts,
    unreachable_tokens,
    vocabulary_sizes,
)
from tagloom.plans import prompts as jobs
from tagloom.plans.exploration import LENGTH_RANGE, RATINGS
from tagloom.plans.vectors import VectorSetParams, cluster_map, vector_set
from tagloom.sources.readers import (
    GROUP_FILES,
    read_cluster_map,
    read_json_object,
    read_revision,
    read_tag_groups,
)
from tagloom.sources.revisions import Dataset, Folder
from tagloom.sources.staging import staged
from tagloom.sources.writers import tsv_lines, write_cluster_map, write_json_object
from workload.corpus import (
    CALIBRATION_FLOORS,
    FIRST_YEAR,
    GROUPS,
    SCORE_FLOORS,
    Corpus,
    corpus,
)

SEED = 12345
FINETUNE = replace(jobs.FINETUNE, score_floors=SCORE_FLOORS)
CALIBRATION = replace(
    jobs.CALIBRATION, score_floors=CALIBRATION_FLOORS, first_year=FIRST_YEAR
)
SCORE_RANGE = (0, 100, 50)
COUNT_RANGE = (1, 1000, 100)
HIDDEN_SIZE = 64
TOP_K = 30
PADDED = 32
PADDING = 3
# Components of vectors that are turned into digests at a time.
DIGEST_CELLS = 1 << 15

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}


def query(build: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(corpus(spark, sf_dir))

    _queries[build.__name__] = run
    return build


def all_queries() -> dict[str, Query]:
    return dict(_queries)


def joined(items: Column, of=None) -> Column:
    texts = items if of is None else F.transform(items, of)
    return F.array_join(texts, ", ")


def numbers(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), " ")


def clusters_text(other: Column, of) -> Column:
    return F.array_join(F.transform(other, lambda tags: joined(tags, of)), " | ")


# Cleaning


@query
def posts_clean(c: Corpus) -> DataFrame:
    return clean.with_general_tags(c.posts)


@query
def text_only(c: Corpus) -> DataFrame:
    texts = clean.rename_to_text(c.posts)
    return texts.where(has_text(F.col("text")))


@query
def head_sample(c: Corpus) -> DataFrame:
    return head(c.posts, 1000)


@query
def score_filter(c: Corpus) -> DataFrame:
    kept = clean.above_score_floor(c.posts, dict(SCORE_FLOORS))
    return kept.select("id", "rating", "score")


@query
def year_filter(c: Corpus) -> DataFrame:
    kept = clean.from_year(c.posts, FIRST_YEAR)
    return kept.select("id", iso_year(F.col("created_at")).alias("year"))


@query
def size_caps(c: Corpus) -> DataFrame:
    capped = clean.within_caps(clean.with_general_tags(c.posts), 5, 10)
    n = tag_count(F.col("general"))
    return capped.where(n <= 100).select("id", n.alias("n_general"))


# Vocabulary


@query
def tag_frequency(c: Corpus) -> DataFrame:
    return most_frequent_first(tag_counts(c.posts))


@query
def popular_tags(c: Corpus) -> DataFrame:
    return popular(tag_counts(c.posts), c.min_count).select("field", "tag", "cnt")


@query
def vocab_build(c: Corpus) -> DataFrame:
    return build_vocabulary(c.posts, c.vocabulary_params())


@query
def vocab_build_encode(c: Corpus) -> DataFrame:
    kinds = ("general", "character", "copyright")
    return build_vocabulary(c.posts, c.vocabulary_params("encode", kinds))


@query
def vocab_build_masked(c: Corpus) -> DataFrame:
    return build_vocabulary(c.posts, c.vocabulary_params("masked", ("general",)))


@query
def vocab_duplicates(c: Corpus) -> DataFrame:
    """What two vocabularies put together would list twice."""
    masked = build_vocabulary(c.posts, c.vocabulary_params("masked", ("general",)))
    found = duplicate_tokens(c.vocab.unionByName(masked))
    return found.select("token", "n", joined(F.col("kinds")).alias("kinds"))


@query
def vocab_sizes(c: Corpus) -> DataFrame:
    return vocabulary_sizes(c.vocab)


def _document_posts(c: Corpus) -> DataFrame:
    return c.table("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("general"))


@query
def document_frequency(c: Corpus) -> DataFrame:
    return tag_counts(_document_posts(c), ("general",))


@query
def document_pieces(c: Corpus) -> DataFrame:
    pieces = _document_posts(c).select(F.explode(tokenize(F.col("general"))).alias("piece"))
    return pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))


@query
def vocab_unreachable(c: Corpus) -> DataFrame:
    params = VocabularyParams("masked", ("general",), {"general": 2})
    return unreachable_tokens(build_vocabulary(_document_posts(c), params)).select("token", "cnt")


# Statistics


@query
def rating_counts(c: Corpus) -> DataFrame:
    return stats.rating_counts(c.posts)


@query
def tags_per_post(c: Corpus) -> DataFrame:
    return stats.tags_per_post(c.posts)


@query
def length_histogram(c: Corpus) -> DataFrame:
    lengths = c.posts.select(tag_count(F.col("general")).alias("n_tags"))
    return stats.histogram(lengths, "n_tags", *LENGTH_RANGE).select("bin", "n")


@query
def score_histogram(c: Corpus) -> DataFrame:
    return stats.histogram(
        stats.score_counts(c.posts),
        "score",
        *SCORE_RANGE,
        by="rating",
        groups=RATINGS,
        weight=F.col("n"),
    ).select("rating", "bin", "left_edge", "n")


@query
def count_histogram(c: Corpus) -> DataFrame:
    counts = tag_counts(c.posts)
    return stats.histogram(
        counts, "cnt", *COUNT_RANGE, by="field", groups=("general", "copyright", "character")
    ).select("field", "bin", "n")


@query
def score_boxplot(c: Corpus) -> DataFrame:
    return stats.score_boxplot(stats.score_counts(c.posts))


@query
def boundary_scores(c: Corpus) -> DataFrame:
    return stats.boundary_scores(stats.score_counts(c.posts))


@query
def quality_bands(c: Corpus) -> DataFrame:
    return stats.quality_bands(stats.score_counts(c.posts))


# Tokens describing a post


@query
def aspect_ratio_tags(c: Corpus) -> DataFrame:
    token = aspect_ratio_token()
    return c.posts.select("id", token.alias("aspect_token"))


@query
def length_tags(c: Corpus) -> DataFrame:
    counted = c.posts.select("id", tag_count(F.col("general")).alias("n_tags"))
    return counted.withColumn("length_token", length_token("n_tags"))


@query
def rating_tags(c: Corpus) -> DataFrame:
    return c.posts.select(
        "id",
        exact_rating().alias("exact"),
        coarse_rating().alias("coarse"),
        fuzzy_rating(0.25, SEED).alias("fuzzy"),
    )


# Encoding. A lookup by requests writes and moves the whole rows, hence only the columns in use.


def _general(c: Corpus) -> DataFrame:
    return clean.with_general_tags(c.posts).select("id", "general")


@query
def unknown_reject(c: Corpus) -> DataFrame:
    cleaned = clean.with_general_tags(c.posts).select("id", "copyright", "character")
    known = c.encoder.reject_unknown(cleaned, "copyright", "character")
    return known.select("id", "copyright", "character")


@query
def unknown_tag_report(c: Corpus) -> DataFrame:
    parts = [
        unknown_tags(c.posts, column, c.vocab).select(F.lit(column).alias("field"), "tag", "n_posts")
        for column in ("general", "copyright", "character")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def drop_unknown(c: Corpus) -> DataFrame:
    tokens = c.encoder.known_tokens(_general(c), "general")
    return tokens.select(
        "id", F.size("tokens").alias("n"), joined(F.col("tokens"), organize.named).alias("tags")
    )


@query
def encode_tags(c: Corpus) -> DataFrame:
    encoded = c.encoder.encode(_general(c), "general")
    return encoded.select("id", numbers(F.col("token_ids")).alias("token_ids"))


@query
def encode_tags_joined(c: Corpus) -> DataFrame:
    """The same by a join, as with a vocabulary too large for a literal."""
    encoded = c.joined_encoder.encode(_general(c), "general")
    return encoded.select("id", numbers(F.col("token_ids")).alias("token_ids"))


@query
def detokenize(c: Corpus) -> DataFrame:
    """Texts of the prompts' ids without their special tokens."""
    rows = jobs.accepted(jobs.pretrain_rows(c.posts, c.encoder, GROUPS), "id", "input_ids")
    return decode(rows.select("id", "input_ids"), "input_ids", decoder(c.vocab)).select("id", "text")


# Organising and composing


def _known(c: Corpus) -> DataFrame:
    return jobs.known_posts(c.posts, c.encoder, jobs.Caps())


def _by_group(c: Corpus) -> DataFrame:
    grouped = organize.organize_by_group(_known(c), "tokens", GROUPS, organize.named)
    return organize.as_one_cluster(grouped)


def _by_cluster(c: Corpus) -> DataFrame:
    level = compose.identity_level(FINETUNE.identity_rates, SEED)
    leveled = c.posts.withColumn("level", level)
    return jobs.clustered_posts(leveled, c.encoder, jobs.Caps(), c.clusters, GROUPS)


@query
def organize_group(c: Corpus) -> DataFrame:
    """Groups of whole, uncleaned tag strings."""
    tags = c.posts.where(has_text(F.col("general"))).select(
        "id", split_tags(F.col("general")).alias("tags")
    )
    names = ("people", "focus", "watermark", "artistic_error", "rest")
    grouped = organize.organize_by_group(tags, "tags", GROUPS)
    return grouped.select("id", *[joined(F.col(n)).alias(n) for n in names])


@query
def organize_cluster(c: Corpus) -> DataFrame:
    return _by_cluster(c).select(
        "id",
        "level",
        "unclustered",
        F.size("other").alias("n_clusters"),
        clusters_text(F.col("other"), organize.named).alias("other"),
    )


@query
def common_tags(c: Corpus) -> DataFrame:
    tokens = compose.with_common_tokens(_by_group(c), compose.ComposeParams())
    return tokens.select("id", "length_token", "rating_token", "aspect_token")


@query
def identity_levels(c: Corpus) -> DataFrame:
    def level(params: jobs.FinetuneParams) -> Column:
        return compose.identity_level(params.identity_rates, SEED)

    return c.posts.select(
        "id", level(FINETUNE).alias("finetune"), level(CALIBRATION).alias("calibration")
    )


@query
def condition_rates(c: Corpus) -> DataFrame:
    return c.posts.select("id", compose.condition_rate(FINETUNE.compose).alias("rate"))


def _parts(df: DataFrame) -> DataFrame:
    return select_where(
        df,
        F.col("composable"),
        "id",
        joined(F.col("condition"), organize.named).alias("condition"),
        joined(F.col("completion"), organize.named).alias("completion"),
        joined(F.col("copyright_tags")).alias("copyright"),
        joined(F.col("character_tags")).alias("character"),
    )


@query
def recompose(c: Corpus) -> DataFrame:
    split = compose.recompose(_by_cluster(c), FINETUNE.compose)
    return _parts(split).select("id", "condition", "completion")


@query
def condition_keep(c: Corpus) -> DataFrame:
    return _parts(compose.condition_keeping_identity(_by_cluster(c), FINETUNE.compose))


@query
def condition_free(c: Corpus) -> DataFrame:
    return _parts(compose.condition_free(_by_group(c), FINETUNE.compose))


def _texts(df: DataFrame) -> DataFrame:
    names = ("copyright", "character", "condition", "completion")
    return select_where(
        df,
        F.col("composable"),
        "id",
        *[F.col(f"{n}_text").alias(n) for n in names],
        "rating_token",
        "aspect_token",
        "length_token",
    )


@query
def components_plain(c: Corpus) -> DataFrame:
    params = compose.ComposeParams()
    return _texts(compose.components_plain(_by_group(c), params, organize.named))


@query
def components_keep(c: Corpus) -> DataFrame:
    made = compose.components_keeping_identity(_by_cluster(c), FINETUNE.compose, organize.named)
    return _texts(made)


@query
def components_free(c: Corpus) -> DataFrame:
    return _texts(compose.components_free(_by_group(c), FINETUNE.compose, organize.named))


# Prompts


@query
def prompt_pretrain(c: Corpus) -> DataFrame:
    rows = jobs.pretrain_rows(c.posts, c.encoder, GROUPS)
    return jobs.accepted(rows, "id", "text")


@query
def prompt_sft(c: Corpus) -> DataFrame:
    rows = jobs.finetune_rows(c.posts, c.encoder, c.clusters, GROUPS, FINETUNE)
    return jobs.accepted(rows, "id", "text")


@query
def quarantine_sft(c: Corpus) -> DataFrame:
    rows = jobs.finetune_rows(c.posts, c.encoder, c.clusters, GROUPS, FINETUNE)
    return jobs.quarantined(rows)


@query
def prompt_inference(c: Corpus) -> DataFrame:
    """Every post as a request, padded with blanks; even ids ask in the pretraining layout."""
    cleaned = clean.with_general_tags(c.posts).withColumn("n", tag_count(F.col("general")))

    def padded(column: str) -> Column:
        return F.concat(F.lit(" "), F.col(column), F.lit(" \n"))

    layout = F.when(F.col("id") % 2 == 0, "pretrain").otherwise("sft")
    prompt = P.inference_prompt(
        layout,
        padded("copyright"),
        padded("character"),
        padded("general"),
        exact_rating(),
        aspect_ratio_token(),
        length_token("n"),
        F.lit(C.IDENTITY_NONE),
    )
    return cleaned.select("id", prompt.alias("prompt"))


def section_tokens(posts: DataFrame) -> DataFrame:
    """Old-style token lists with a rating section; one post in 20 lacks its last mark."""

    def section(start: str, tags: Column, end: str) -> Column:
        return F.concat(F.array(F.lit(start)), tags, F.array(F.lit(end)))

    rating = F.concat(
        F.lit("rating:"), F.when(F.col("rating").isin("q", "e"), "nsfw").otherwise("sfw")
    )
    whole = F.concat(
        F.array(F.lit(C.BOS)),
        section(C.RATING_START, F.array(rating), C.RATING_END),
        section(C.COPYRIGHT_START, tokenize(F.col("copyright")), C.COPYRIGHT_END),
        section(C.CHARACTER_START, tokenize(F.col("character")), C.CHARACTER_END),
        F.array(F.lit(C.GENERAL_START)),
        tokenize(F.col("general")),
        F.when(F.col("id") % 20 == 3, F.array().cast("array<string>")).otherwise(
            F.array(F.lit(C.GENERAL_END))
        ),
    )
    return posts.select("id", whole.alias("tokens"))


@query
def prompt_sections(c: Corpus) -> DataFrame:
    """Sections in their new order; lists without their last mark have no text."""
    marks = (C.RATING_END, C.COPYRIGHT_END, C.CHARACTER_END, C.GENERAL_END)
    skipped = [C.BOS, C.RATING_START, C.COPYRIGHT_START, C.CHARACTER_START, C.GENERAL_START]
    cut = section_tokens(clean.with_general_tags(c.posts)).withColumn(
        "parts", P.cut_sections(F.col("tokens"), marks)
    )
    names = ("part_0", "part_1", "part_2", "part_3")
    shown = [
        F.filter(F.col(f"parts.{n}"), lambda t: ~t.isin(*skipped)) for n in names
    ]
    text = P.plain_rating_words(
        F.array_join(P.reorder_sections(*shown, people=GROUPS.people), ", ")
    )
    return cut.select("id", text.alias("text"), F.col("parts.part_3").isNull().alias("cut_short"))


# Prepared sets


def _set(rows: DataFrame) -> DataFrame:
    return rows.select("id", "text", numbers(F.col("input_ids")).alias("input_ids"), "split")


@query
def pretrain_set(c: Corpus) -> DataFrame:
    params = replace(jobs.PretrainParams(), test_size=c.test_size)
    return _set(jobs.pretrain_set(c.posts, c.encoder, GROUPS, params))


@query
def sft_set(c: Corpus) -> DataFrame:
    params = replace(FINETUNE, test_size=c.test_size)
    return _set(jobs.finetune_set(c.posts, c.encoder, c.clusters, GROUPS, params))


@query
def sft_set_joined(c: Corpus) -> DataFrame:
    """The same set by joins, as with tables too large for a literal."""
    params = replace(FINETUNE, test_size=c.test_size)
    made = jobs.finetune_set(c.posts, c.joined_encoder, c.joined_clusters, GROUPS, params)
    return _set(made)


@query
def calib_set(c: Corpus) -> DataFrame:
    params = replace(CALIBRATION, test_size=c.test_size)
    return _set(jobs.finetune_set(c.posts, c.encoder, c.clusters, GROUPS, params))


@query
def vector_training_set(c: Corpus) -> DataFrame:
    rows = vector_set(c.posts, c.encoder, VectorSetParams(test_size=c.test_size))
    return rows.select("id", numbers(F.col("input_ids")).alias("input_ids"), "split")


@query
def test_split(c: Corpus) -> DataFrame:
    return train_test_split(c.posts.select("id"), c.test_size)


# Vectors


@query
def cosine_topk(c: Corpus) -> DataFrame:
    """Every token whose id 20 divides asks; all tokens answer."""
    asked = c.vocab.where(F.col("token_id") % 20 == 0).select("token")
    found = vectors.similar_tags(asked, c.vectors, TOP_K)
    return found.select("query", "rank", "token", F.round("similarity", 6).alias("similarity"))


def _digests(lists: pa.Array) -> pa.Array:
    """Per list one whole number for each vector, made of all its components; - for none."""
    vectors = lists.flatten()
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    known = vectors.is_valid().to_numpy(zero_copy_only=False)
    size = max(1, len(flat) // max(1, known.sum()))
    weights, step = np.arange(1, size + 1), size * max(1, DIGEST_CELLS // size)
    found = np.zeros(len(known), np.int64)
    whole = (
        np.floor(flat[at : at + step].astype(np.float64) * 10_000 + 0.5).astype(np.int64)
        for at in range(0, len(flat), step)
    )
    if known.any():
        found[known] = np.concatenate([w.reshape(-1, size) @ weights for w in whole])
    texts = pc.fill_null(pc.cast(pa.array(found, mask=~known), pa.string()), "-")
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, texts), " ")


@query
def cosine_topk_pruned(c: Corpus) -> DataFrame:
    """The same, of all shards that may hold one of the k best."""
    asked = c.vocab.where(F.col("token_id") % 20 == 0).select("token")
    found = similar_tags_pruned(asked, c.vectors, TOP_K)
    return found.select("query", "rank", "token", F.round("similarity", 6).alias("similarity"))


@query
def vector_lookup(c: Corpus) -> DataFrame:
    """Per post a digest of all components of each of its tags' vectors; unknown ids have none."""
    encoded = c.encoder.encode(_general(c), "general", "ids")
    digests = Made(_digests, StringType())
    found = vectors.lookup_vectors(encoded, "ids", c.vectors, "digests", digests)
    return found.select("id", numbers(F.col("ids")).alias("ids"), "digests")


def _level(c: Corpus, level: str) -> DataFrame:
    return c.cluster_map.where(F.col("level") == level).select("token", "cluster_id")


@query
def cluster_members(c: Corpus) -> DataFrame:
    members = vectors.cluster_members(_level(c, "lax"))
    return members.select("cluster_id", "n", joined(F.col("tags")).alias("tags"))


@query
def same_cluster(c: Corpus) -> DataFrame:
    """The most frequent tag of each cluster asks for its cluster."""
    listed = c.cluster_map.where((F.col("level") == "strict") & F.col("cnt").isNotNull())
    leader = F.max(F.struct(F.col("cnt"), F.col("token"))).alias("leader")
    asked = listed.groupBy("cluster_id").agg(leader).select("leader.token")
    return vectors.same_cluster(asked, _level(c, "strict"))


@query
def embedding_transfer(c: Corpus) -> DataFrame:
    """Vectors handed on to the vocabulary in its other order."""
    kinds = ("general", "character", "copyright")
    vocab = build_vocabulary(c.posts, c.vocabulary_params("encode", kinds))
    made = vectors.transfer_vectors(vocab, c.vectors, HIDDEN_SIZE)
    texts = F.transform(
        "embedding", lambda x: F.round(x.cast("double"), 4).cast("decimal(10,4)").cast("string")
    )
    return made.select("token_id", "token", "copied", F.array_join(texts, " ").alias("embedding"))


@query
def vector_tsv(c: Corpus) -> DataFrame:
    """The exported lines, numbers rounded as engines print floats differently."""
    rounded = F.transform(
        "embedding", lambda x: F.round(x.cast("double"), 5).cast("decimal(10,5)")
    )
    return tsv_lines(c.all_vectors.withColumn("embedding", rounded))


@query
def kmeans_map(c: Corpus) -> DataFrame:
    """What must hold for every token with a vector: its cluster is one of those asked for and the
    nearest one, and the clusters cost no more than those of any single run."""
    k, n_init, max_iter = 8, 2, 15
    vectors = staged(c.vectors, "clustered")
    fitted = fit_clusters(vectors, k, n_init, max_iter, SEED)
    single = [fit_clusters(vectors, k, 1, max_iter, SEED + i).cost for i in range(n_init)]
    cheapest = fitted.cost <= min(single) * (1 + 1e-9)

    def distance(centre) -> Column:
        numbers = F.array(*(F.lit(float(x)) for x in centre))
        squares = F.zip_with("embedding", numbers, lambda x, y: (x - y) * (x - y))
        return F.aggregate(squares, F.lit(0.0), lambda a, x: a + x)

    distances = F.array(*(distance(centre) for centre in fitted.centres))
    found = fitted.assign(vectors).join(vectors.select("token", distances.alias("d")), "token")
    own = F.get("d", F.col("cluster_id"))
    return found.select(
        "token",
        F.col("cluster_id").between(0, k - 1).alias("in_range"),
        (own <= F.array_min("d") * (1 + 1e-9) + 1e-9).alias("nearest"),
        F.lit(cheapest).alias("cheapest"),
    )


# Files


@query
def revision_read(c: Corpus) -> DataFrame:
    """An older revision by its name, after a newer one was published."""
    data = Dataset(c.spark, c.folder("posts"))
    data.write("first", {"all": c.posts})
    data.write("even", {"all": c.posts.where("id % 2 = 0")})
    return read_revision(c.spark, data.root, "first")


@query
def split_read(c: Corpus) -> DataFrame:
    """Both splits of a published revision, made in one pass over the posts."""
    data = Dataset(c.spark, c.folder("set"))
    data.write_split("v1", c.posts, c.n_posts, c.test_size, SEED)
    return data.read().select("id", "general", "score", "split")


@query
def tag_group_files(c: Corpus) -> DataFrame:
    """Files of one tag per line, and back; the general tags are dealt into groups by id."""
    folder = c.folder("groups")
    general = c.vocab.where("kind = 'general'").select("token_id", "token").collect()
    for number, name in enumerate(GROUP_FILES):
        tags = sorted(r["token"] for r in general if r["token_id"] % len(GROUP_FILES) == number)
        Folder(c.spark, folder).put(f"{name}.txt", "".join(f"{t} \n" for t in tags))
    return read_tag_groups(c.spark, folder)


@query
def cluster_map_files(c: Corpus) -> DataFrame:
    path = c.folder("clusters")
    write_cluster_map(_level(c, "lax"), path)
    return read_cluster_map(c.spark, path)


@query
def get_or_train(c: Corpus) -> DataFrame:
    """A map is trained once: asked for again, it is the one that was kept."""
    path, calls = c.folder("trained"), []

    def training() -> DataFrame:
        calls.append(1)
        return c.vectors

    first, again = (cluster_map(c.spark, path, training, 4, n_init=1, max_iter=5) for _ in range(2))
    both = first.join(again.withColumnRenamed("cluster_id", "again"), "token")
    return both.select("token", (F.col("cluster_id") == F.col("again")).alias("same"), F.lit(len(calls)).alias("trainings"))


@query
def json_object_files(c: Corpus) -> DataFrame:
    """The counts of all general tags as one JSON object, and back."""
    path = c.folder("counts")
    counts = tag_counts(c.posts, ("general",)).select("tag", "cnt")
    write_json_object(counts, "tag", "cnt", path)
    return read_json_object(c.spark, path, "tag", "cnt")


@query
def merged_tag_counts(c: Corpus) -> DataFrame:
    """From the summaries of two halves of the posts, put together."""
    return totals.tag_counts(_merged_summary(c))


@query
def merged_quality_bands(c: Corpus) -> DataFrame:
    return stats.quality_bands(totals.score_counts(_merged_summary(c)))


@query
def merged_tags_per_post(c: Corpus) -> DataFrame:
    return totals.tags_per_post(_merged_summary(c))


def _merged_summary(c: Corpus) -> DataFrame:
    halves = (totals.summarize(c.posts.where(F.col("id") % 2 == k)) for k in (0, 1))
    return staged(totals.merged(*halves), "summary")


@query
def reason_counts(c: Corpus) -> DataFrame:
    """How many posts of the fine-tuning set failed for what, counted while the others are written."""
    rows = jobs.finetune_rows(c.posts, c.encoder, c.clusters, GROUPS, FINETUNE)
    counts = jobs.write_accepted(rows, lambda kept: kept.write.parquet(c.folder("accepted")))
    return c.spark.createDataFrame([(reason or "accepted", n) for reason, n in counts.items()], "reason string, n bigint")


# Labels


def _sft_ids(c: Corpus) -> DataFrame:
    """Whole rows with some padding at their end."""
    rows = jobs.finetune_rows(c.posts, c.encoder, c.clusters, GROUPS, FINETUNE)
    padding = F.array_repeat(F.lit(c.encoder.pad_id), PADDING)
    ids = jobs.accepted(rows, "id", "input_ids")
    return ids.select("id", F.concat("input_ids", padding).alias("ids"))


@query
def pad_truncate(c: Corpus) -> DataFrame:
    """Ids at a length that some rows exceed and others don't reach."""
    rows = jobs.finetune_rows(c.posts, c.encoder, c.clusters, GROUPS, FINETUNE)
    padded = L.pad_or_truncate(F.col("input_ids"), c.encoder.pad_id, PADDED)
    ids = jobs.accepted(rows, "id", "input_ids")
    return ids.select("id", numbers(padded).alias("ids"))


@query
def causal_labels(c: Corpus) -> DataFrame:
    labels = L.causal_labels(F.col("ids"), c.encoder.pad_id)
    return _sft_ids(c).select("id", numbers(labels).alias("labels"))


@query
def completion_labels(c: Corpus) -> DataFrame:
    end = c.encoder.special[C.INPUT_END]
    labels = L.completion_labels(F.col("ids"), end, c.encoder.pad_id)
    return _sft_ids(c).select("id", numbers(labels).alias("labels"))


@query
def mlm_labels(c: Corpus) -> DataFrame:
    encoded = c.encoder.encode(_general(c), "general", "ids")
    special = sorted(c.encoder.special.values())
    size = c.vocab.count()
    both = L.masked_token_labels(
        "ids", special, c.encoder.special[C.MASK], size, SEED
    )
    return encoded.select("id", both.alias("both")).select(
        "id",
        numbers(F.col("both.input_ids")).alias("input_ids"),
        numbers(F.col("both.labels")).alias("labels"),
    )
