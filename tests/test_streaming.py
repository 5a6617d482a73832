"""Incremental landing: new payload files are flattened and appended once;
a re-delivered file adds nothing; a restart resumes from the checkpoint."""

from __future__ import annotations

import json
import os

from terrapanel.streaming.landing import land
from tests.test_sources import SAMPLE, payload


def test_landing_stream(spark, tmp_dir):
    inbox, target, ckpt = f"{tmp_dir}/inbox", f"{tmp_dir}/landed", f"{tmp_dir}/ckpt"
    os.makedirs(inbox)
    with open(f"{inbox}/a.json", "w") as f:
        json.dump(SAMPLE, f)
    land(spark, inbox, target, checkpoint=ckpt, name="t1")
    assert spark.read.parquet(target).count() == 4

    # second batch: one new locality plus a re-delivery of the first file
    with open(f"{inbox}/b.json", "w") as f:
        json.dump(payload([("2304400", "Fortaleza", ["2700000", "2720000"])]), f)
    with open(f"{inbox}/c.json", "w") as f:
        json.dump(SAMPLE, f)
    land(spark, inbox, target, checkpoint=ckpt, name="t1")
    landed = spark.read.parquet(target)
    assert landed.count() == 6
    assert landed.select("localidade_id", "ano", "variavel_id").distinct().count() == 6
