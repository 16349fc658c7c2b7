"""URL filter by a path-template tree for each host.

A URL's path is a way down its host's tree. Level by level, segments that vary
without meaning (many different ones of the same shape, most of them rare) become
their shape, a wildcard. Then sibling branches whose subtrees and labels are
statistically alike are merged, and templates whose smoothed share of good labels
is low are rejected.

Levels are grouped aggregations over light rows; only aggregated templates of a
host meet in one task, never its URLs.
"""

from __future__ import annotations

import math
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, cut, fresh, maybe_broadcast


def shape(segment: Column) -> Column:
    """``{hex}`` for long hexadecimal names with digits, else digits as ``{n}``, else ``*``."""
    is_hex = segment.rlike("^[0-9a-fA-F-]{8,}$") & segment.rlike("[0-9]") & segment.rlike("[a-fA-F]")
    return F.when(is_hex, "{hex}").when(segment.rlike("[0-9]"), F.regexp_replace(segment, "[0-9]+", "{n}")).otherwise("*")


def split_url(url: Column, max_depth: int | None) -> tuple[Column, Column]:
    """Host and segments; the sorted names of parameters are one more segment, deeper ones than ``max_depth`` are ``**``."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "(?s)#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^[^@]*@|:[0-9]*$", "")
    parts = F.filter(F.split(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+"), lambda s: s != "")
    if max_depth is not None:
        parts = F.when(F.size(parts) > max_depth, F.concat(F.slice(parts, 1, max_depth), F.array(F.lit("**")))).otherwise(parts)
    names = F.array_sort(F.array_distinct(F.transform(F.filter(F.split(F.regexp_extract(bare, "(?s)[?](.*)$", 1), "&"), lambda p: p != ""), lambda p: F.regexp_extract(p, "^[^=]*", 0))))
    query = F.when(F.size(names) > 0, F.array(F.concat(F.lit("?"), F.array_join(names, "&")))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", host), F.concat(parts, query)


def alike(a: dict, b: dict, max_distance: float, max_z: float) -> bool:
    """Whether two branches could be two samples of one: subtrees close in total variation, label rates within ``max_z``.

    The distance allowed grows by what chance alone gives for samples of their size.
    """
    na, nb = sum(a["tails"].values()), sum(b["tails"].values())
    kinds = set(a["tails"]) | set(b["tails"])
    distance = sum(abs(a["tails"].get(k, 0) / na - b["tails"].get(k, 0) / nb) for k in kinds) / 2
    if distance > max_distance + math.sqrt(len(kinds) * (1 / na + 1 / nb)) / 4:
        return False
    la, lb = a["labelled"], b["labelled"]
    if not la or not lb:
        return True
    p = (a["good"] + b["good"]) / (la + lb)
    spread = math.sqrt(p * (1 - p) * (1 / la + 1 / lb))
    return spread == 0 or abs(a["good"] / la - b["good"] / lb) <= max_z * spread


def merge_host(templates: list[tuple[tuple[str, ...], int, int, int]], max_distance: float, max_z: float) -> list[tuple[str, ...]]:
    """New names for one host's templates (segments, rows, labelled, good), deepest levels first.

    Siblings are taken from the largest down; each joins the first cluster that it
    is like. A cluster of several is named ``{a|b|c}``; wildcards stay as they are.
    """
    now = [t[0] for t in templates]
    for level in range(max((len(t) for t in now), default=0) - 1, -1, -1):
        families: dict = defaultdict(lambda: defaultdict(lambda: {"tails": defaultdict(int), "labelled": 0, "good": 0}))
        for name, (segments, n, labelled, good) in zip(now, templates):
            if len(name) > level:
                branch = families[segments[:level]][name[level]]
                branch["tails"][name[level + 1 :]] += n
                branch["labelled"] += labelled
                branch["good"] += good
        renamed: dict = {}
        for prefix, branches in families.items():
            clusters: list[tuple[list[str], dict]] = []
            free = [s for s in branches if "*" not in s and "{" not in s and not s.startswith("?")]
            for s in sorted(free, key=lambda s: (-sum(branches[s]["tails"].values()), s)):
                for members, whole in clusters:
                    if alike(whole, branches[s], max_distance, max_z):
                        members.append(s)
                        for k, n in branches[s]["tails"].items():
                            whole["tails"][k] += n
                        whole["labelled"] += branches[s]["labelled"]
                        whole["good"] += branches[s]["good"]
                        break
                else:
                    clusters.append(([s], {"tails": defaultdict(int, branches[s]["tails"]), "labelled": branches[s]["labelled"], "good": branches[s]["good"]}))
            for members, _ in clusters:
                if len(members) > 1:
                    label = "{" + "|".join(sorted(members)) + "}"
                    renamed |= {(prefix, s): label for s in members}
        now = [(*name[:level], renamed.get((t[0][:level], name[level]), name[level]), *name[level + 1 :]) if len(name) > level else name for name, t in zip(now, templates)]
    return now


def filter_urls(
    pages: DataFrame,
    good: Column,
    few_numbers: int = 3,
    few_words: int = 8,
    rare_share: float = 0.3,
    max_depth: int | None = None,
    max_distance: float = 0.15,
    max_z: float = 2.0,
    strength: float = 8.0,
    min_purity: float = 0.7,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row for each row of ``pages``: ``id_col, host, template, labelled, purity, rejected``.

    ``good`` is a boolean column of ``pages``, null where there is no label.

    Below one node, segments of one shape are generalised when there are at least
    ``few_numbers`` of them (``few_words`` for a shape without digits) and their
    number is at least ``rare_share`` of their rows, however many there are; so
    frequent ones stay branches. ``alike`` says which siblings are merged. Paths are
    followed to their end, unless ``max_depth`` is given. A template's purity is its share of good
    labels, smoothed by ``strength`` labels at its host's share, which is smoothed
    alike by that of all; a template is rejected if that is below ``min_purity``.
    Without any label in the table the share of all is 1.

    A null URL, and one without a host, has null host, template and purity and is
    not rejected. A bare host has the template ``/``. Repeated rows count as often
    as they occur and come out as often. An empty table gives no rows. Other
    columns are ignored.
    """
    (mark,) = fresh(pages, "good_label")
    host, segments = split_url(col(pages, url_col), max_depth)
    rows = pages.withColumn(mark, good).select(col(pages, id_col).alias("id"), host.alias("host"), segments.alias("segments"), F.col(mark).alias("good"))
    rows = cut(rows.withColumn("done", F.when(F.col("host").isNotNull(), F.array().cast("array<string>"))))
    depth = rows.agg(F.max(F.when(F.col("host").isNotNull(), F.size("segments")))).first()[0] or 0
    for level in range(depth):
        here = F.get("segments", F.lit(level))
        rows = rows.withColumn("seg", here).withColumn("kind", F.when(F.col("seg").rlike("^[?]|^[*]{2}$"), F.lit(None)).otherwise(shape(F.col("seg"))))
        # The number of different segments of a shape below a node, by two hash aggregations.
        each = rows.filter("host IS NOT NULL AND kind IS NOT NULL").groupBy("host", "done", "kind", "seg").agg(F.count("*").alias("n"))
        stats = each.groupBy("host", "done", "kind").agg(F.count("*").alias("different"), F.sum("n").alias("all"))
        least = F.when(F.col("kind") == "*", few_words).otherwise(few_numbers)
        wild = stats.filter((F.col("different") >= least) & (F.col("different") >= rare_share * F.col("all")))
        wild = cut(wild.select(F.col("host").alias("w_host"), F.col("done").alias("w_done"), F.col("kind").alias("w_kind")))
        joined = rows.join(maybe_broadcast(wild, wild.count()), (F.col("host") == F.col("w_host")) & (F.col("done") == F.col("w_done")) & (F.col("kind") == F.col("w_kind")), "left")
        name = F.when(F.col("w_kind").isNotNull(), F.col("w_kind")).otherwise(F.col("seg"))
        grown = F.when(F.col("seg").isNotNull(), F.concat("done", F.array(name))).otherwise(F.col("done"))
        rows = joined.withColumn("done", grown).select("id", "host", "segments", "good", "done")
        if level % 4 == 3:
            rows = cut(rows)

    labelled = F.count("good")
    templates = rows.filter("host IS NOT NULL").groupBy("host", "done").agg(F.count("*").alias("n"), labelled.alias("labelled"), F.count_if("good").alias("good"))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        items = [(tuple(d), int(n), int(k), int(g)) for d, n, k, g in zip(pdf["done"], pdf["n"], pdf["labelled"], pdf["good"])]
        order = sorted(range(len(items)), key=lambda i: items[i][0])
        names = merge_host([items[i] for i in order], max_distance, max_z)
        out = pdf.iloc[order].copy()
        out["template"] = ["/" + "/".join(x) for x in names]
        return out

    named = cut(templates.groupBy("host").applyInPandas(merge, "host string, done array<string>, n long, labelled long, good long, template string"))
    total = named.agg(F.sum("labelled"), F.sum("good")).first()
    share = (total[1] + 1.0) / (total[0] + 1.0) if total[0] else 1.0
    hosts = named.groupBy("host").agg(F.sum("labelled").alias("hl"), F.sum("good").alias("hg"))
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("hg") + strength * share) / (F.col("hl") + strength)).alias("host_share"))
    merged = named.groupBy("host", "template").agg(F.sum("labelled").alias("tl"), F.sum("good").alias("tg"))
    merged = merged.join(hosts, F.col("host") == F.col("h"))
    purity = F.round((F.col("tg") + strength * F.col("host_share")) / (F.col("tl") + strength), 6)
    merged = merged.select(F.col("host").alias("m_host"), F.col("template").alias("m_template"), F.col("tl"), purity.alias("purity"))
    verdicts = named.join(merged, (F.col("host") == F.col("m_host")) & (F.col("template") == F.col("m_template")))
    verdicts = cut(verdicts.select(F.col("host").alias("v_host"), F.col("done").alias("v_done"), "template", "tl", "purity"))
    out = rows.join(maybe_broadcast(verdicts, verdicts.count()), (F.col("host") == F.col("v_host")) & (F.col("done") == F.col("v_done")), "left")
    return out.select(F.col("id").alias(id_col), "host", "template", F.col("tl").alias("labelled"), "purity", F.coalesce(F.col("purity") < min_purity, F.lit(False)).alias("rejected"))
