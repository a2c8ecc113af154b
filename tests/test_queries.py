"""Registered queries against their SQL. A cross-section runs by default, all of them with EOFRAME_ALL=1."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
SOME = [
    "training_set_build", "annotation_profile", "label_sets", "patch_sample_v2", "row_split_70_15_15", "label_changes",
    "complete_patches", "radar_questions", "evaluation_report", "answer_audit", "crs_normalisation", "image_validation",
    "pair_validation", "box_matching", "disagreement", "final_confidence", "execution_traces", "band_stretch",
    "spectral_indices", "service_health", "instruction_files", "manifest_files", "report_files", "patch_store_files",
    "query_intent", "execution_traces", "pair_assembly", "crs_compatibility", "reconcile_stream", "gather_stream", "type_caps",
    "balanced_cap", "change_gap_stats", "self_pair_balance", "temporal_dataset", "normalised_predictions", "modality_sections",
    "request_lifecycle", "trace_stream", "disagreement_reports", "matched_pairs", "confidence_records", "zipped_predictions",
    "stable_shuffle", "multilabel_sample", "mixture_build", "contract_vqa", "contract_caption", "contract_grounding", "contract_change",
    "contract_fusion", "lineage_closure", "lineage_summary", "provenance_full", "versioned_store", "imagery_index_files",
    "raster_catalog_files", "file_verification", "target_grid", "packed_stack", "radar_product", "served_boxes", "chat_rendering",
    "image_json_text", "dimension_limits", "patch_split_v2", "pair_facts",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(queries()) if os.environ.get("EOFRAME_ALL") else SOME)
def test_query_equals_its_sql(spark, con, name):
    assert compare(queries()[name](spark, SF), con, oracle_sql()[name]) is None


def test_every_query_has_sql_and_entry_runs(spark):
    assert {n for n in queries() if not n.startswith("op") and n != "pipeline"} == {n for n in oracle_sql() if not n.startswith("op")}
    assert entry(spark).count() > 0


def test_patch_split_labels_every_train_entry(spark, con):
    got = queries()["patch_split_v2"](spark, SF)
    assert got.count() == con.execute("select count(*) from lineitem where l_orderkey % 10 > 2").fetchone()[0]
