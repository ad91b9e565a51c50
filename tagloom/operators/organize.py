"""Sorting a post's tags into groups, and the ungrouped rest into clusters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom import constants as C
from tagloom.operators.lookup import TagTable, Wanted, resolve_all

TagOf = Callable[[Column], Column]
_MAX_GROUPED = 100_000


def plain(tag: Column) -> Column:
    """Items that are the tag itself."""
    return tag


def named(token: Column) -> Column:
    """Items that are struct (tag, token_id)."""
    return token["tag"]


@dataclass(frozen=True)
class TagGroups:
    """Four tag lists. A tag in several belongs to the first that has it, in this order."""

    people: tuple[str, ...] = C.PEOPLE_TAGS
    focus: tuple[str, ...] = C.FOCUS_TAGS
    watermark: tuple[str, ...] = C.WATERMARK_TAGS
    artistic_error: tuple[str, ...] = C.ARTISTIC_ERROR_TAGS

    def disjoint(self) -> dict[str, list[str]]:
        taken: set[str] = set()
        groups = {}
        for name in ("people", "focus", "watermark", "artistic_error"):
            groups[name] = [t for t in dict.fromkeys(getattr(self, name)) if t not in taken]
            taken.update(groups[name])
        return groups

    @classmethod
    def from_table(cls, tag_groups: DataFrame) -> TagGroups:
        """From a (group_name, tag) table. The lists are hand-kept and stay small; checked."""
        rows = tag_groups.select("group_name", "tag").limit(_MAX_GROUPED + 1).collect()
        if len(rows) > _MAX_GROUPED:
            raise ValueError(f"more than {_MAX_GROUPED} grouped tags")
        lists: dict[str, list[str]] = {}
        for name, tag in rows:
            lists.setdefault(name, []).append(tag)
        return cls(**{name: tuple(sorted(tags)) for name, tags in lists.items()})


def among(tag: Column, names: list[str]) -> Column:
    """True for one of the names."""
    return tag.isin(*names) if names else F.lit(False)


def organize_by_group(
    df: DataFrame, tags: str, groups: TagGroups = TagGroups(), tag_of: TagOf = plain
) -> DataFrame:
    """Add people, focus, watermark, artistic_error and rest, each in the order of the tags."""
    lists = groups.disjoint()
    grouped = [t for names in lists.values() for t in names]

    def members(names: list[str]) -> Column:
        return F.filter(F.col(tags), lambda x: among(tag_of(x), names))

    columns = {name: members(names) for name, names in lists.items()}
    columns["rest"] = F.filter(F.col(tags), lambda x: ~among(tag_of(x), grouped))
    return df.withColumns(columns)


def as_one_cluster(df: DataFrame) -> DataFrame:
    """Add `other`: the ungrouped tags as a single, maybe empty, cluster."""
    return df.withColumn("other", F.array(F.col("rest")))


def cluster_key(level: Column, tag: Column) -> Column:
    """Key of a cluster table that holds several maps, one per identity level."""
    return F.concat_ws("|", level, tag)


def by_cluster(
    df: DataFrame, clusters: TagTable, tag_of: TagOf = plain, level: Column | None = None
) -> DataFrame:
    """Add `other`: one list per cluster, clusters and tags in the order first seen.

    `unclustered` tells whether some tag has no cluster. With a `level` column the table's keys
    are `cluster_key`s; rows of level `none` get a single cluster.
    """

    def key(item: Column) -> Column:
        return tag_of(item) if level is None else cluster_key(level, tag_of(item))

    keys = F.transform(F.col("rest"), key)
    found = resolve_all(df, [Wanted(keys, clusters, "_clusters")])
    ids = F.col("_clusters")
    return _in_clusters(found, ids, lambda _, i: F.get(ids, i), level).drop("_clusters")


def by_own_cluster(df: DataFrame, level: Column | None = None) -> DataFrame:
    """As `by_cluster`, of items that hold their cluster as `cluster_id`; nothing is looked up."""
    ids = F.transform(F.col("rest"), lambda item: item["cluster_id"])
    return _in_clusters(df, ids, lambda item, _: item["cluster_id"], level)


def _in_clusters(
    df: DataFrame, ids: Column, id_of: Callable[[Column, Column], Column], level: Column | None
) -> DataFrame:
    """`ids` are the clusters of the rest, `id_of` that of an item at a place."""

    def members(cluster: Column) -> Column:
        return F.filter(F.col("rest"), lambda item, i: id_of(item, i).eqNullSafe(cluster))

    other = F.transform(F.array_distinct(ids), members)
    lost = F.exists(ids, lambda c: c.isNull())
    if level is not None:
        other = F.when(level == "none", F.array(F.col("rest"))).otherwise(other)
        lost = (level != "none") & lost
    return df.withColumns({"other": other, "unclustered": lost})
