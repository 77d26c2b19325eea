"""Images that documents name: data URLs are decoded and measured, quotas kept, and what can't be shown becomes a paragraph."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.units import image_size
from ..functions.values import data_url, image_source, is_webp, raster_info
from .order import greedy_quota, running_ids

EACH_CAP, TOTAL_CAP = 8 << 20, 20 << 20
REASONS = {"quota": "크기 초과", "remote": "외부 이미지", "broken": "읽을 수 없는 이미지", "kind": "지원하지 않는 이미지", "path": "상대 경로 이미지"}


def fetched(source: Column, fetch: Callable[[str], bytes | None]) -> Column:
    """Bytes of remote images by a function of the caller's; off unless asked for, since executors need not have a network."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda u: fetch(u) if isinstance(u, str) else None).astype(object)

    return F.pandas_udf(run, "binary")(F.when(source.rlike("(?i)^https?://"), source))


def resolve(assets: DataFrame, key: str, fetch: Callable[[str], bytes | None] | None = None) -> DataFrame:
    """assets with data, kind, width and height in units, bin_name, reason (null where the image is shown) and fallback (the paragraph's text)."""
    src = image_source(F.col("source"))
    named = assets.withColumn("_src", src).withColumn("_url", data_url(src))
    remote = F.col("_src").rlike("(?i)^https?://")
    data = F.coalesce("data", "_url.data")
    if fetch is not None:
        data = F.coalesce(data, fetched(F.col("_src"), fetch))
    got = named.withColumn("_data", data).withColumn("_info", raster_info(F.col("_data")))
    sized = got.withColumn("_order", F.concat(F.lpad(F.split("block_id", r"\.").getItem(0), 9, "0"), F.lit("."), F.col("block_id"))).withColumn("_size", F.when(F.col("_info").isNotNull(), F.length("_data")))
    taken = greedy_quota(sized, [key], "_order", "_size", EACH_CAP, TOTAL_CAP)
    reason = (
        F.when(F.col("accepted"), F.lit(None))
        .when(F.col("_size").isNotNull(), REASONS["quota"])
        .when(F.col("_data").isNotNull() | is_webp(F.col("_data")), REASONS["kind"])
        .when(remote, REASONS["remote"])
        .when(F.col("_src").rlike("(?i)^data:"), REASONS["broken"])
        .otherwise(REASONS["path"])
    )
    size = image_size(F.col("_info.width"), F.col("_info.height"))
    out = taken.withColumn("reason", reason).withColumns({"data": F.when(F.col("accepted"), F.col("_data")), "kind": F.col("_info.kind"), "width": F.coalesce("width", size["width"].cast("int")), "height": F.coalesce("height", size["height"].cast("int"))})
    out = running_ids(out.withColumn("_shown", F.col("accepted").cast("int")), [key, "_shown"], ["_order"], 1, "_n")
    suffix = F.when(F.col("kind") == "jpeg", "jpg").otherwise(F.col("kind"))
    label = F.when(F.coalesce("alt", F.lit("")) != "", F.col("alt")).otherwise(F.substring("_src", 1, 240))
    return out.withColumns({"bin_name": F.when(F.col("accepted"), F.coalesce("bin_name", F.concat(F.lit("image"), F.col("_n").cast("string"), F.lit("."), suffix))), "fallback": F.when(F.col("reason").isNotNull(), F.concat(F.lit("[이미지: "), label, F.lit("]")))}).drop("_src", "_url", "_data", "_info", "_order", "_size", "_n", "_shown", "accepted")
