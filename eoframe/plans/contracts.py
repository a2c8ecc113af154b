"""Response contracts over answers drawn from the detections: of each nine, eight break the contract in one way each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eoframe.operators import contracts
from eoframe.plans.registry import query, sql_text
from eoframe.sources.adapters import Tables, oracle

CONF = '"confidence": {"score": <c>}'
PROV = '"provenance": {"model_name": "m", "checkpoint_version": "1"}'
BOX = '{"x_min": <x>, "y_min": <y>, "x_max": 1, "y_max": 1.5, "label": "<k>"}'
#: Per task: (payload, violations) by turns; <x>, <y>, <c> and <k> are numbers of the row.
CASES = {
    "vqa": [
        (f'{{"answer": "yes", {CONF}, {PROV}, "evidence_regions": [{BOX}, {BOX}]}}', ""),
        (f'{{"answer": 7, {CONF}, {PROV}}}', "answer: not string"),
        (f'{{{CONF}, {PROV}, "evidence_regions": []}}', "answer: missing"),
        (f'{{"answer": "a", "confidence": {{"score": 1<k>}}, {PROV}}}', "confidence.score: above 1"),
        (f'{{"answer": "a", "confidence": {{"score": -0.5}}, {PROV}}}', "confidence.score: below 0"),
        (f'{{"answer": "a", {CONF}, "provenance": {{}}}}', "provenance.model_name: missing"),
        (f'{{"answer": "a", {CONF}, {PROV}, "evidence_regions": [{BOX}, {{"x_min": 1, "y_min": "2", "x_max": 3}}]}}',
         "evidence_regions[1].y_min: not number,evidence_regions[1].y_max: missing"),
        (f'{{"answer": "a", {CONF}, {PROV}', "unreadable"),
        ('["answer"]', "payload: not object"),
    ],
    "caption": [
        (f'{{"caption": "<k>", {CONF}, {PROV}, "execution_time_ms": <k>.5}}', ""),
        (f'{{"caption": null, {CONF}, {PROV}}}', "caption: not string"),
        (f'{{"caption": "c", "confidence": <c>, {PROV}}}', "confidence: not object"),
        (f'{{"caption": "c", "confidence": {{"method": "m"}}, {PROV}}}', "confidence.score: missing"),
        (f'{{"caption": "c", "confidence": {{"score": "high"}}, {PROV}}}', "confidence.score: not number"),
        (f'{{"caption": "c", {CONF}, "provenance": {{"model_name": <k>}}}}', "provenance.model_name: not string"),
        (f'{{"caption": "c", {CONF}, {PROV}, "execution_time_ms": "fast"}}', "execution_time_ms: not number"),
        (f'{{"caption": "c", {CONF}}}', "provenance: missing"),
        ("", "unreadable"),
    ],
    "grounding": [
        (f'{{"boxes": [{BOX}], "expression": "e", {CONF}, {PROV}, "more": [<k>]}}', ""),
        (f'{{"boxes": [], "expression": "e", {CONF}, {PROV}}}', ""),
        (f'{{"boxes": {BOX}, "expression": "e", {CONF}, {PROV}}}', "boxes: not array"),
        (f'{{"boxes": [<k>, {BOX}], "expression": "e", {CONF}, {PROV}}}', "boxes[0]: not object"),
        (f'{{"boxes": [{{"x_max": <x>}}], "expression": "e", {CONF}, {PROV}}}',
         "boxes[0].x_min: missing,boxes[0].y_min: missing,boxes[0].y_max: missing"),
        (f'{{"boxes": [{BOX}], {CONF}, {PROV}}}', "expression: missing"),
        (f'{{"expression": true, {CONF}, {PROV}}}', "boxes: missing,expression: not string"),
        (f'{{"boxes": [{BOX}], "expression": "e", "confidence": {{"score": <c>, "factors": 1}}, {PROV}}}',
         "confidence.factors: not object"),
        ("{}", "boxes: missing,expression: missing,confidence: missing,provenance: missing"),
    ],
    "change": [
        (f'{{"description": "d", "change_detected": true, "answer": null, {CONF}, {PROV}, "change_regions": [{BOX}]}}', ""),
        (f'{{"description": "d", "change_detected": false, "answer": "<k>", {CONF}, {PROV}}}', ""),
        (f'{{"description": "d", "change_detected": "true", {CONF}, {PROV}}}', "change_detected: not boolean"),
        (f'{{"description": "d", "change_detected": true, "answer": <k>, {CONF}, {PROV}}}', "answer: not string or null"),
        (f'{{"change_detected": true, {CONF}, {PROV}}}', "description: missing"),
        (f'{{"description": "d", {CONF}, {PROV}}}', "change_detected: missing"),
        (f'{{"description": "d", "change_detected": true, {CONF}, {PROV}, "change_regions": [[]]}}', "change_regions[0]: not object"),
        (f'{{"description": "d", "change_detected": true, "confidence": {{"score": 2}}, {PROV}}}', "confidence.score: above 1"),
        ("no json", "unreadable"),
    ],
    "fusion": [
        (f'{{"fused_answer": "a", "modality_attribution": {{"optical_evidence": "o", "sar_evidence": "s", "fused_reasoning": "f"}}, {CONF}, {PROV}}}', ""),
        (f'{{"fused_answer": "a", "modality_attribution": {{"optical_evidence": "o", "fused_reasoning": "f"}}, {CONF}, {PROV}}}',
         "modality_attribution.sar_evidence: missing"),
        (f'{{"fused_answer": "a", "modality_attribution": {{"optical_evidence": <k>, "sar_evidence": null, "fused_reasoning": "f"}}, {CONF}, {PROV}}}',
         "modality_attribution.optical_evidence: not string,modality_attribution.sar_evidence: not string"),
        (f'{{"fused_answer": "a", "modality_attribution": "both", {CONF}, {PROV}}}', "modality_attribution: not object"),
        (f'{{"modality_attribution": {{}}, {CONF}, {PROV}}}',
         "fused_answer: missing,modality_attribution.optical_evidence: missing,modality_attribution.sar_evidence: missing,"
         "modality_attribution.fused_reasoning: missing"),
        (f'{{"fused_answer": "a", {CONF}, {PROV}, "disagreement_flag": 1}}', "modality_attribution: missing,disagreement_flag: not boolean"),
        (f'{{"fused_answer": "a", {CONF}, {PROV}, "sar_evidence_overlay": []}}', "modality_attribution: missing,sar_evidence_overlay: not object"),
        ("null", "payload: not object"),
        (f'{{"fused_answer": ["a"], {CONF}, {PROV}, "modality_attribution": {{"optical_evidence": "o", "sar_evidence": "s", "fused_reasoning": "f"}}}}',
         "fused_answer: not string"),
    ],
}
NUMBERS = {"<x>": "cast(x as varchar(20))", "<y>": "cast(y as varchar(20))", "<c>": "cast(confidence as varchar(20))",
           "<k>": "cast(pk as varchar(20))"}


def turn(cases: list[str]) -> str:
    return "case sk % 9 " + " ".join(f"when {i} then {c}" for i, c in enumerate(cases)) + " end"


def filled(template: str) -> str:
    """SQL text that puts the row's numbers into a payload."""
    sql = sql_text(template)
    for mark, column in NUMBERS.items():
        sql = sql.replace(mark, f"' || {column} || '")
    return sql


def _register(task: str) -> None:
    payload, violations = turn([filled(p) for p, _ in CASES[task]]), turn([sql_text(v) for _, v in CASES[task]])

    @query(oracle(f"select ann_id, {violations} as violations, sk % 9 in ({', '.join(str(i) for i, (_, v) in enumerate(CASES[task]) if not v)}) as conforms from detections",
                  "detections"), name=f"contract_{task}")
    def contract(t: Tables) -> DataFrame:
        out = contracts.check_response(t.detections.select("ann_id", F.expr(payload.replace("varchar(20)", "string")).alias("payload")), task)
        return out.select("ann_id", F.array_join("violations", ",").alias("violations"), "conforms")


for _task in CASES:
    _register(_task)
