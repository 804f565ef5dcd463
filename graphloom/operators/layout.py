"""Deterministic 3-D positions of nodes and communities."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S


def on_sphere(rows: DataFrame, radius: float, order: str = "id", group: str | None = None, parts: int = 64) -> DataFrame:
    """rows with pos: evenly over a sphere by their order, which has no ties.

    Ordinals are counts of the parts before and ranks inside a part, so no window holds all rows; parts are cut at quantiles of at most
    1,024 rows drawn by a hash.
    """
    if group is not None:
        w = Window.partitionBy(group)
        return rows.withColumn("pos", S.sphere_point(F.row_number().over(w.orderBy(order)) - 1, F.count("*").over(w), radius))
    drawn = sorted(r[0] for r in rows.select(order).distinct().orderBy(F.xxhash64(order), order).limit(1024).collect() if r[0] is not None)
    cuts = sorted({drawn[i * len(drawn) // parts] for i in range(1, parts)}) if drawn else []
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    dealt = rows.withColumn("_p", part)
    per = dealt.groupBy("_p").agg(F.count("*").alias("_n"))
    total = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select("_p", F.coalesce(F.sum("_n").over(total), F.lit(0)).alias("_b"), F.sum("_n").over(Window.partitionBy()).alias("_all"))  # a row for each part
    i = F.col("_b") + F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1
    return dealt.join(F.broadcast(before), "_p").withColumn("pos", S.sphere_point(i, F.col("_all"), radius)).drop("_p", "_b", "_all")


def flat_positions(nodes: DataFrame, member: DataFrame, radius: float = 400.0, base: float = 18.0, most: float = 160.0) -> DataFrame:
    """id, x, y, z: communities on a sphere, their members on small spheres around them with a jitter, the rest in the middle."""
    centres = on_sphere(member.select("community_id").distinct(), radius, "community_id").select("community_id", F.col("pos").alias("centre"))
    first = member.groupBy("node_id").agg(F.min_by("community_id", F.struct(-F.col("level"), "community_id")).alias("community_id"))
    w = Window.partitionBy("community_id")
    i, n = F.row_number().over(w.orderBy("node_id")) - 1, F.count("*").over(w)
    placed = first.withColumn("around", S.sphere_point(i, n, S.ring(base, n, most))).join(centres, "community_id")
    out = nodes.select("id").join(placed.withColumnRenamed("node_id", "id"), "id", "left").withColumn("j", S.jitter(F.col("id"), 4.0))
    axis = lambda a: (F.coalesce(F.col(f"centre.{a}") + F.col(f"around.{a}"), F.lit(0.0)) + F.col(f"j.{a}")).alias(a)
    return out.select("id", axis("x"), axis("y"), axis("z"))


def asteroid(seed, least: float = 900.0, most: float = 1200.0):
    """A place in a shell, from the bits of the seed's md5."""
    h = F.md5(seed)
    part = lambda at: F.conv(F.substring(h, at, 4), 16, 10).cast("double") / 65535.0
    theta, phi = part(29) * (2 * math.pi), F.acos(1 - 2 * part(25))
    r = F.cbrt(F.lit(least**3) + part(21) * (most**3 - least**3))
    return F.struct((r * F.sin(phi) * F.cos(theta)).alias("x"), (r * F.sin(phi) * F.sin(theta)).alias("y"), (r * F.cos(phi)).alias("z"))


def solar_positions(nodes: DataFrame, member: DataFrame, radii: dict[int, float] = {0: 600.0, 1: 180.0, 2: 70.0}, own: float = 25.0) -> DataFrame:  # noqa: B006
    """id, tier, x, y, z of communities of three levels around each other, entities around theirs, and orphans in a shell."""
    from .graph import parents_by_vote

    at = None
    for level in (0, 1, 2):
        rows = member.where(F.col("level") == level).select(F.col("community_id").alias("id")).distinct()
        if level == 0:
            placed = on_sphere(rows, radii[0]).select("id", "pos")
        else:
            up = parents_by_vote(member, level, level - 1).select(F.col("child").alias("id"), "parent")
            w = Window.partitionBy("parent")
            i, n = F.row_number().over(w.orderBy("id")) - 1, F.count("*").over(w)
            near = rows.join(up, "id", "left").withColumn("p", S.sphere_point(i, n, S.ring(radii[level] / 2, n, radii[level] * 2)))
            near = near.join(at.select(F.col("id").alias("parent"), F.col("pos").alias("c")), "parent", "left")
            placed = near.select("id", F.struct(*((F.coalesce(F.col(f"c.{a}"), F.lit(0.0)) + F.col(f"p.{a}")).alias(a) for a in "xyz")).alias("pos"))
        placed = placed.withColumn("tier", F.lit(level))
        at = placed if at is None else at.unionByName(placed)
    first = member.groupBy("node_id").agg(F.max_by("community_id", "level").alias("parent"))
    w = Window.partitionBy("parent")
    i, n = F.row_number().over(w.orderBy("node_id")) - 1, F.count("*").over(w)
    planets = first.withColumn("p", S.sphere_point(i, n, S.ring(own / 2, n, own * 4))).join(at.select(F.col("id").alias("parent"), F.col("pos").alias("c")), "parent")
    planets = planets.select(F.col("node_id").alias("id"), F.struct(*((F.col(f"c.{a}") + F.col(f"p.{a}")).alias(a) for a in "xyz")).alias("pos"), F.lit(3).alias("tier"))
    rest = nodes.where("kind = 'indexable'").select("id").join(first.select(F.col("node_id").alias("id")), "id", "left_anti").select("id", asteroid(F.col("id")).alias("pos"), F.lit(4).alias("tier"))
    return at.unionByName(planets).unionByName(rest).select("id", "tier", "pos.x", "pos.y", "pos.z")


def spring(ids: list[str], pairs: list[tuple[str, str]], k: float = 220.0, steps: int = 80, gravity: float = 0.02) -> np.ndarray:
    """Force-directed positions; the start comes from each id's md5, so they are the same each time."""
    import hashlib

    n, at = len(ids), {x: i for i, x in enumerate(ids)}
    pos = np.array([[(int(hashlib.md5(x.encode()).hexdigest()[j : j + 6], 16) / 0xFFFFFF - 0.5) * k * 2 for j in (0, 6, 12)] for x in ids]).reshape(n, 3)
    e = np.array([(at[a], at[b]) for a, b in pairs if a in at and b in at and a != b], dtype=int).reshape(-1, 2)
    heat = k
    for _ in range(steps):
        move = -gravity * pos
        for a in range(0, n, 512):
            d = pos[a : a + 512, None, :] - pos[None, :, :]
            r = np.maximum(np.linalg.norm(d, axis=2), 0.01)
            move[a : a + 512] += (d / r[:, :, None] * (k * k / r)[:, :, None]).sum(1)
        if len(e):
            d = pos[e[:, 0]] - pos[e[:, 1]]
            r = np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 0.01)
            pull = d / r * (r * r / k)
            np.add.at(move, e[:, 0], -pull)
            np.add.at(move, e[:, 1], pull)
        size = np.maximum(np.linalg.norm(move, axis=1, keepdims=True), 1e-9)
        pos = pos + move / size * np.minimum(size, heat)
        heat *= 0.95
    return pos


def spring_positions(nodes: DataFrame, edges: DataFrame, group: str = "group") -> DataFrame:
    """id, x, y, z by force-directed layout of each group of nodes(group, id) with edges(group, src, dst); a group, a community say, must fit a task."""

    def run(key: tuple, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(n["id"])
        pos = spring(ids, list(zip(e["src"], e["dst"], strict=True)))
        return pd.DataFrame({"id": ids, "x": pos[:, 0], "y": pos[:, 1], "z": pos[:, 2]})

    return nodes.groupBy(group).cogroup(edges.withColumnRenamed(group, "_group").groupBy("_group")).applyInPandas(run, "id string, x double, y double, z double")


def centroids(positions: DataFrame, member: DataFrame) -> DataFrame:
    """community_id, x, y, z: the mean place of each community's members."""
    rows = member.select("community_id", F.col("node_id").alias("id")).distinct().join(positions, "id")
    return rows.groupBy("community_id").agg(*(F.avg(a).alias(a) for a in "xyz"))


def nearest(positions: DataFrame, node: str, radius: float, k: int) -> DataFrame:
    """The k nearest others of a node within a radius: id, distance."""
    me = positions.where(F.col("id") == node).select("x", "y", "z").first()
    if me is None:
        return positions.select("id", F.lit(0.0).alias("distance")).limit(0)
    d = F.sqrt(sum((F.col(a) - F.lit(me[a])) ** 2 for a in "xyz"))
    return positions.where(F.col("id") != node).select("id", F.round(d, 6).alias("distance")).where(F.col("distance") <= radius).orderBy("distance", "id").limit(k)
