"""The query pack: name -> (callable(spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

from terravox.plans import evaluation_plans, incremental_plans, loop_plans, map_plans, match_plans, model_plans, preprocess_plans, segment_plans, shape_plans, stream_plans, voxel_plans, window_plans

PACK = voxel_plans.PACK | segment_plans.PACK | match_plans.PACK | map_plans.PACK | evaluation_plans.PACK | stream_plans.PACK | preprocess_plans.PACK | shape_plans.PACK | model_plans.PACK | incremental_plans.PACK | loop_plans.PACK | window_plans.PACK
