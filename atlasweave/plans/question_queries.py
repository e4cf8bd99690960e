"""The 38 questions as registered queries, over definitions that are made from the warehouse tables, each with DuckDB SQL.

Nations stand for reports, suppliers for their fields and for a flow's artifacts, parts for its steps.  The statements that make
nodes, edges and values are plain SQL that Spark and DuckDB read alike; the answers are computed apart: in Spark by the question
bank's patterns, in DuckDB by the natural joins below.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from ..sources.lift import Graph
from .question_bank import FLOW_QUESTIONS, REPORT_QUESTIONS

_N, _S, _P = "FROM {nation}", "FROM {supplier}", "FROM {part}"
_REL = f"{_N} WHERE n_nationkey % 5 <> 0"
_COLUMNS = "FROM (SELECT DISTINCT s_suppkey % 10 AS k FROM {supplier})"
_SECTIONS = "FROM (SELECT DISTINCT s_nationkey AS n, s_suppkey % 3 AS k FROM {supplier})"
_STATUS = "FROM {nation} JOIN (SELECT DISTINCT r_regionkey AS i FROM {region}) ON i <= n_nationkey % 3 WHERE n_nationkey % 6 <> 5"
_REVISIONS = "FROM {nation} JOIN (SELECT DISTINCT r_regionkey AS i FROM {region}) ON i BETWEEN 1 AND 2 WHERE n_nationkey % 2 = 0"
_CHANGES = "FROM {supplier} WHERE s_nationkey % 2 = 0"
_USED = "FROM (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM {lineitem})"
_PARAMETERS = "FROM (SELECT DISTINCT s_suppkey % 9 AS k FROM {supplier})"

#: By type: id and label.
NODES = {
    "ReportType": f"SELECT 'report/' || n_nationkey AS id, n_name AS label {_N}",
    "Component": "SELECT 'component/' || r_regionkey AS id, r_name AS label FROM {region}",
    **{t: f"SELECT 'step/' || p_partkey AS id, p_name AS label {_P} WHERE p_size % 5 = {k}" for k, t in enumerate(("DeterministicStep", "OcrStep", "ClaudeStep", "HumanStep", "TerminalStep"))},
}
#: By relation: src and dst.
EDGES = {
    "inReport": f"SELECT 'field/' || s_suppkey AS src, 'report/' || s_nationkey AS dst {_S}",
    "inSection": f"SELECT 'field/' || s_suppkey AS src, 'section/' || s_nationkey || '-' || s_suppkey % 3 AS dst {_S}",
    "hasField": f"SELECT 'section/' || s_nationkey || '-' || s_suppkey % 3 AS src, 'field/' || s_suppkey AS dst {_S} UNION ALL SELECT 'artifact/' || s_suppkey, 'afield/' || s_suppkey {_S} WHERE s_suppkey % 4 = 1",
    "hasMeaning": f"SELECT 'field/' || s_suppkey AS src, 'meaning/' || s_suppkey || '/en' AS dst {_S} UNION ALL SELECT 'field/' || s_suppkey, 'meaning/' || s_suppkey || '/fr' {_S} WHERE s_suppkey % 3 = 0",
    "hasSection": f"SELECT 'report/' || n AS src, 'section/' || n || '-' || k AS dst {_SECTIONS}",
    "renderedBy": f"SELECT 'section/' || n || '-' || k AS src, 'component/' || (n + k) % 5 AS dst {_SECTIONS}",
    "derivedFrom": f"SELECT 'report/' || n_nationkey AS src, 'src/' || n_nationkey AS dst {_N} WHERE n_nationkey % 4 <> 0",
    "usedSource": f"SELECT 'run/' || n_nationkey AS src, 'src/' || n_nationkey AS dst {_N}",
    "hasApproval": f"SELECT 'run/' || n_nationkey AS src, 'approval/' || n_nationkey AS dst {_N} WHERE n_nationkey % 2 = 1",
    "hasRule": f"SELECT 'field/' || s_suppkey AS src, 'rule/' || s_suppkey AS dst {_S} WHERE s_suppkey % 4 = 1",
    "sourcedFrom": f"SELECT 'field/' || s_suppkey AS src, 'column/' || s_suppkey % 10 AS dst {_S} WHERE s_suppkey % 4 <> 0",
    "inTable": f"SELECT 'column/' || k AS src, 'table/' || k % 3 AS dst {_COLUMNS}",
    "inDataSource": f"SELECT 'table/' || k % 3 AS src, 'source/0' AS dst {_COLUMNS} WHERE k = 0",
    "readsTable": f"SELECT 'report/' || n_nationkey AS src, 'table/' || n_nationkey % 3 AS dst {_N} WHERE n_nationkey % 7 <> 0",
    "hasParameter": f"SELECT 'report/' || n_nationkey AS src, 'param/' || n_nationkey AS dst {_N} UNION ALL SELECT 'release/' || n_nationkey, 'param/' || n_nationkey {_REL}",
    "boundToColumn": f"SELECT 'param/' || n_nationkey AS src, 'column/' || n_nationkey % 10 AS dst {_N} WHERE n_nationkey % 2 = 0",
    "releasedAs": f"SELECT 'report/' || n_nationkey AS src, 'release/' || n_nationkey AS dst {_REL}",
    "hasSchedule": f"SELECT 'release/' || n_nationkey AS src, 'schedule/' || n_nationkey AS dst {_REL} AND n_nationkey % 3 = 0",
    "hasVerificationPolicy": f"SELECT 'release/' || n_nationkey AS src, 'verify/' || n_nationkey AS dst {_REL} AND n_nationkey % 2 = 0",
    "hasApprovalPolicy": f"SELECT 'release/' || n_nationkey AS src, 'approve/' || n_nationkey AS dst {_REL} AND n_nationkey % 4 = 0",
    "universeQuery": f"SELECT 'param/' || n_nationkey AS src, 'query/' || n_nationkey AS dst {_N} WHERE n_nationkey % 4 = 1",
    "hasPublishPolicy": f"SELECT 'release/' || n_nationkey AS src, 'publish/' || n_nationkey AS dst {_REL} AND n_nationkey % 3 = 1",
    "hasObservabilityPolicy": f"SELECT 'release/' || n_nationkey AS src, 'observe/' || n_nationkey AS dst {_REL} AND n_nationkey % 3 = 2",
    "hasStatusChange": f"SELECT 'report/' || n_nationkey AS src, 'status/' || n_nationkey || '/' || i AS dst {_STATUS}",
    "hasRevision": f"SELECT 'report/' || n_nationkey AS src, 'revision/' || n_nationkey || '/' || i AS dst {_REVISIONS}",
    "hasChange": f"SELECT 'revision/' || s_nationkey || '/2' AS src, 'change/' || s_suppkey AS dst {_CHANGES}",
    "reads": f"SELECT 'step/' || p AS src, 'artifact/' || s AS dst {_USED} WHERE s % 3 = 0 AND (p + s) % 4 = 1",
    "readsOptional": f"SELECT 'step/' || p AS src, 'artifact/' || s AS dst {_USED} WHERE s % 3 = 1",
    "writes": f"SELECT 'step/' || p AS src, 'artifact/' || s AS dst {_USED} WHERE s % 3 = 2 OR (s % 3 = 0 AND (p + s) % 25 = 0)",
    "carries": f"SELECT 'artifact/' || s_suppkey AS src, 'concept/' || s_suppkey % 7 AS dst {_S} WHERE s_suppkey % 5 <> 0",
    "hasCheck": f"SELECT 'step/' || p_partkey AS src, 'check/' || p_partkey AS dst {_P} WHERE p_partkey % 2 = 0",
    "onFail": f"SELECT 'check/' || p_partkey AS src, 'outcome/' || p_partkey || '/fail' AS dst {_P} WHERE p_partkey % 2 = 0",
    "measures": f"SELECT 'check/' || p_partkey AS src, 'metric/' || p_partkey % 11 AS dst {_P} WHERE p_partkey % 6 = 0",
    "comparedTo": f"SELECT 'check/' || p_partkey AS src, 'parameter/' || p_partkey % 9 AS dst {_P} WHERE p_partkey % 4 = 0",
    "records": f"SELECT 'step/' || p_partkey AS src, 'metric/' || p_partkey % 11 AS dst {_P} WHERE p_partkey % 5 = 0",
    "usesParameter": f"SELECT 'step/' || p_partkey AS src, 'parameter/' || p_partkey % 9 AS dst {_P} WHERE p_partkey % 10 = 0 UNION ALL SELECT 'transition/' || p_partkey, 'parameter/' || p_partkey % 9 {_P} WHERE p_partkey % 7 = 0",
    "hasOutcome": f"SELECT 'step/' || p_partkey AS src, 'outcome/' || p_partkey || '/ok' AS dst {_P} UNION ALL SELECT 'step/' || p_partkey, 'outcome/' || p_partkey || '/fail' {_P} WHERE p_partkey % 2 = 0",
    "from": f"SELECT 'transition/' || p_partkey AS src, 'step/' || p_partkey AS dst {_P}",
    "onOutcome": f"SELECT 'transition/' || p_partkey AS src, 'outcome/' || p_partkey || '/ok' AS dst {_P} WHERE p_partkey % 8 <> 0",
    "to": f"SELECT 'transition/' || p_partkey AS src, 'step/' || (p_partkey + 1) AS dst {_P} WHERE p_partkey % 3 <> 0",
    "enforcedBy": f"SELECT 'invariant/' || p_partkey % 13 AS src, 'check/' || p_partkey AS dst {_P} WHERE p_partkey % 4 = 0",
    "implementedBy": f"SELECT 'step/' || p_partkey AS src, 'script/' || p_partkey AS dst {_P} WHERE p_partkey % 3 = 0",
}
#: By property: subj and value.
LITERALS = {
    "reportId": f"SELECT 'report/' || n_nationkey AS subj, lower(n_name) AS value {_N}",
    "locale": f"SELECT 'report/' || n_nationkey AS subj, 'en' AS value {_N} UNION ALL SELECT 'report/' || n_nationkey, 'fr' {_N} WHERE n_regionkey % 2 = 0 UNION ALL SELECT 'meaning/' || s_suppkey || '/en', 'en' {_S} UNION ALL SELECT 'meaning/' || s_suppkey || '/fr', 'fr' {_S} WHERE s_suppkey % 3 = 0",
    "definition": f"SELECT 'meaning/' || s_suppkey || '/en' AS subj, 'what ' || s_name || ' is' AS value {_S} UNION ALL SELECT 'meaning/' || s_suppkey || '/fr', 'ce qu est ' || s_name {_S} WHERE s_suppkey % 3 = 0 UNION ALL SELECT 'param/' || n_nationkey, 'parameter of ' || n_name {_N} WHERE n_nationkey % 2 = 0 UNION ALL SELECT DISTINCT 'concept/' || s_suppkey % 7, 'concept ' || s_suppkey % 7 {_S}",
    "label": f"SELECT 'report/' || n_nationkey AS subj, n_name AS value {_N} UNION ALL SELECT 'meaning/' || s_suppkey || '/en', s_name {_S} WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'component/' || r_regionkey, lower(r_name) FROM {{region}} UNION ALL SELECT 'param/' || n_nationkey, 'as_of' {_N} UNION ALL SELECT 'source/0', 'warehouse' FROM {{region}} WHERE r_regionkey = 0 UNION ALL SELECT 'query/' || n_nationkey, 'universe' {_N} UNION ALL SELECT DISTINCT 'concept/' || s_suppkey % 7, 'c' || s_suppkey % 7 {_S} UNION ALL SELECT 'step/' || p_partkey, p_name {_P}",
    "fieldId": f"SELECT 'field/' || s_suppkey AS subj, 'f' || s_suppkey % 7 AS value {_S}",
    "purpose": f"SELECT 'report/' || n_nationkey AS subj, 'inform on ' || n_name AS value {_N} UNION ALL SELECT 'section/' || n || '-' || k, 'show ' || k {_SECTIONS}",
    "presentWhen": f"SELECT 'section/' || n || '-' || k AS subj, 'always' AS value {_SECTIONS} WHERE k = 1",
    "repoUrl": f"SELECT 'src/' || n_nationkey AS subj, 'repo/' || n_name AS value {_N}", "sha256": f"SELECT 'src/' || n_nationkey AS subj, 'sha' || n_nationkey AS value {_N}",
    "role": f"SELECT 'src/' || n_nationkey AS subj, 'reference' AS value {_N} WHERE n_nationkey % 2 = 0", "referenceKind": f"SELECT 'src/' || n_nationkey AS subj, 'pdf' AS value {_N} WHERE n_nationkey % 3 = 0",
    "flowVersion": f"SELECT 'run/' || n_nationkey AS subj, '2' AS value {_N}", "result": f"SELECT 'run/' || n_nationkey AS subj, 'done' AS value {_N} WHERE n_nationkey % 9 <> 0",
    "engineVersion": f"SELECT 'run/' || n_nationkey AS subj, 'e1' AS value {_N} UNION ALL SELECT 'release/' || n_nationkey, 'e' || n_regionkey {_REL} AND n_nationkey % 7 <> 0",
    "flow": f"SELECT 'run/' || n_nationkey AS subj, 'build' AS value {_N} WHERE n_nationkey % 3 = 0", "startedAt": f"SELECT 'run/' || n_nationkey AS subj, '2024-01-01' AS value {_N} WHERE n_nationkey % 2 = 0",
    "gate": f"SELECT 'approval/' || n_nationkey AS subj, 'layout' AS value {_N}", "decision": f"SELECT 'approval/' || n_nationkey AS subj, 'accept' AS value {_N}", "reviewer": f"SELECT 'approval/' || n_nationkey AS subj, 'reviewer' || n_regionkey AS value {_N}",
    "at": f"SELECT 'approval/' || n_nationkey AS subj, '2024-02-01' AS value {_N} WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'status/' || n_nationkey || '/' || i, '2024-03-0' || (i + 1) {_STATUS} UNION ALL SELECT 'revision/' || n_nationkey || '/' || i, '2024-04-0' || i {_REVISIONS}",
    "ruleText": f"SELECT 'rule/' || s_suppkey AS subj, 'at most ' || s_suppkey AS value {_S}", "regulatory": f"SELECT 'rule/' || s_suppkey AS subj, 'true' AS value {_S} WHERE s_suppkey % 8 = 1",
    "lineageStatus": f"SELECT 'field/' || s_suppkey AS subj, CASE WHEN s_suppkey % 4 = 0 THEN 'unmapped' ELSE 'proposed' END AS value {_S}", "lineageNote": f"SELECT 'field/' || s_suppkey AS subj, 'note' AS value {_S} WHERE s_suppkey % 5 = 0",
    "fieldType": f"SELECT 'field/' || s_suppkey AS subj, CASE WHEN s_suppkey % 3 = 0 THEN 'list' WHEN s_suppkey % 3 = 1 THEN 'percent' ELSE 'series' END AS value {_S}",
    "columnName": f"SELECT 'column/' || k AS subj, 'col' || k AS value {_COLUMNS}", "dataset": f"SELECT DISTINCT 'table/' || k % 3 AS subj, 'ds' AS value {_COLUMNS}", "tableName": f"SELECT DISTINCT 'table/' || k % 3 AS subj, 'tab' || k % 3 AS value {_COLUMNS}",
    "sourceKind": "SELECT 'source/0' AS subj, 'sql' AS value FROM {region} WHERE r_regionkey = 0", "database": "SELECT 'source/1' AS subj, 'db' AS value FROM {region} WHERE r_regionkey = 0",
    "version": f"SELECT 'release/' || n_nationkey AS subj, '1.' || n_nationkey AS value {_REL}", "frozen": f"SELECT 'release/' || n_nationkey AS subj, CASE WHEN n_nationkey % 2 = 0 THEN 'true' ELSE 'false' END AS value {_REL} AND n_nationkey % 3 <> 0",
    "cadence": f"SELECT 'schedule/' || n_nationkey AS subj, 'monthly' AS value {_N} UNION ALL SELECT 'report/' || n_nationkey, 'yearly' {_N} WHERE n_nationkey % 2 = 0",
    "runOn": f"SELECT 'schedule/' || n_nationkey AS subj, 'business_day:3' AS value {_N}", "asOfRule": f"SELECT 'schedule/' || n_nationkey AS subj, 'month_end' AS value {_N}", "timezone": f"SELECT 'schedule/' || n_nationkey AS subj, 'UTC' AS value {_N}", "calendar": f"SELECT 'schedule/' || n_nationkey AS subj, 'cal' AS value {_N} WHERE n_nationkey % 2 = 0",
    "goldenStaticSsimMin": f"SELECT 'verify/' || n_nationkey AS subj, '0.9' AS value {_N}", "overflowBlocking": f"SELECT 'verify/' || n_nationkey AS subj, 'true' AS value {_N}", "fidelityMin": f"SELECT 'verify/' || n_nationkey AS subj, '0.8' AS value {_N} WHERE n_nationkey % 4 = 0",
    "sampleRate": f"SELECT 'approve/' || n_nationkey AS subj, '0.1' AS value {_N}", "sampleMin": f"SELECT 'approve/' || n_nationkey AS subj, '5' AS value {_N}", "fullReviewAfterRelease": f"SELECT 'approve/' || n_nationkey AS subj, 'true' AS value {_N} WHERE n_nationkey % 8 = 0", "reviewerRole": f"SELECT 'approve/' || n_nationkey AS subj, 'analyst' AS value {_N}",
    "allowedValue": f"SELECT 'param/' || n_nationkey AS subj, 'b' AS value {_N} WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'param/' || n_nationkey, 'a' {_N} WHERE n_nationkey % 3 = 0", "boundBy": f"SELECT 'param/' || n_nationkey AS subj, 'run' AS value {_N} WHERE n_nationkey % 3 = 1", "sql": f"SELECT 'query/' || n_nationkey AS subj, 'select 1' AS value {_N} WHERE n_nationkey % 8 = 1",
    "pathPattern": f"SELECT 'publish/' || n_nationkey AS subj, 'out/' || n_nationkey AS value {_N}", "publishFormat": f"SELECT 'publish/' || n_nationkey AS subj, 'pdf' AS value {_N}", "retentionDays": f"SELECT 'publish/' || n_nationkey AS subj, '90' AS value {_N} WHERE n_nationkey % 2 = 0",
    "ontologyVersion": f"SELECT 'release/' || n_nationkey AS subj, 'o1' AS value {_REL}", "libraryVersion": f"SELECT 'release/' || n_nationkey AS subj, 'l1' AS value {_REL} AND n_nationkey % 2 = 0", "font": f"SELECT 'release/' || n_nationkey AS subj, 'sans' AS value {_REL} AND n_nationkey % 4 = 0", "fileHash": f"SELECT 'release/' || n_nationkey AS subj, 'h' || n_nationkey AS value {_REL}", "assetPending": f"SELECT 'release/' || n_nationkey AS subj, 'logo' AS value {_REL} AND n_nationkey % 6 = 0", "waiver": f"SELECT 'release/' || n_nationkey AS subj, 'w' AS value {_REL} AND n_nationkey % 11 = 0",
    "kind": f"SELECT 'report/' || n_nationkey AS subj, 'profile' AS value {_N}", "owner": f"SELECT 'report/' || n_nationkey AS subj, 'desk' || n_regionkey AS value {_N} WHERE n_nationkey % 3 <> 0",
    "deliverWithinHours": f"SELECT 'observe/' || n_nationkey AS subj, '4' AS value {_N}", "maxFailureRate": f"SELECT 'observe/' || n_nationkey AS subj, '0.01' AS value {_N}", "runLog": f"SELECT 'observe/' || n_nationkey AS subj, 'log' AS value {_N}", "alertRecipient": f"SELECT 'observe/' || n_nationkey AS subj, 'ops' AS value {_N} WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'observe/' || n_nationkey, 'desk' {_N} WHERE n_nationkey % 4 = 0",
    "alias": f"SELECT 'field/' || s_suppkey AS subj, 'alias' || s_suppkey % 3 AS value {_S} WHERE s_suppkey % 2 = 0",
    "order": f"SELECT 'status/' || n_nationkey || '/' || i AS subj, CAST(i AS STRING) AS value {_STATUS} UNION ALL SELECT 'revision/' || n_nationkey || '/' || i, CAST(i AS STRING) {_REVISIONS}", "lifecycleStatus": f"SELECT 'status/' || n_nationkey || '/' || i AS subj, CASE i WHEN 0 THEN 'inception' WHEN 1 THEN 'saved' ELSE 'in_validation' END AS value {_STATUS}",
    "changedBy": f"SELECT 'status/' || n_nationkey || '/' || i AS subj, 'ann' AS value {_STATUS} UNION ALL SELECT 'revision/' || n_nationkey || '/' || i, 'bob' {_REVISIONS}", "note": f"SELECT 'status/' || n_nationkey || '/' || i AS subj, 'n' AS value {_STATUS} AND i = 1", "reason": f"SELECT 'revision/' || n_nationkey || '/' || i AS subj, 'why' || i AS value {_REVISIONS}", "effectiveFrom": f"SELECT 'revision/' || n_nationkey || '/' || i AS subj, '2024-05-01' AS value {_REVISIONS} AND i = 2",
    "fact": f"SELECT 'change/' || s_suppkey AS subj, CASE WHEN s_suppkey % 3 = 0 THEN 'title' ELSE 'fields.f' || s_suppkey % 7 || '.label' END AS value {_CHANGES}", "changeKind": f"SELECT 'change/' || s_suppkey AS subj, 'changed' AS value {_CHANGES}", "previousValue": f"SELECT 'change/' || s_suppkey AS subj, 'old' AS value {_CHANGES} AND s_suppkey % 2 = 0", "newValue": f"SELECT 'change/' || s_suppkey AS subj, 'new' AS value {_CHANGES}",
    "stepId": f"SELECT 'step/' || p_partkey AS subj, 's' || p_partkey AS value {_P}", "usesOcr": f"SELECT 'step/' || p_partkey AS subj, 'true' AS value {_P} WHERE p_partkey % 7 = 0", "foreach": f"SELECT 'step/' || p_partkey AS subj, 'page' AS value {_P} WHERE p_partkey % 5 = 0",
    "description": f"SELECT 'step/' || p_partkey AS subj, p_type AS value {_P}",
    "path": f"SELECT 'artifact/' || s_suppkey AS subj, 'out/' || s_suppkey AS value {_S} UNION ALL SELECT 'script/' || p_partkey, 'bin/' || p_partkey {_P}", "format": f"SELECT 'artifact/' || s_suppkey AS subj, CASE WHEN s_suppkey % 2 = 0 THEN 'json' ELSE 'pdf' END AS value {_S}", "fieldPath": f"SELECT 'afield/' || s_suppkey AS subj, '$.x' || s_suppkey AS value {_S}",
    "checkId": f"SELECT 'check/' || p_partkey AS subj, 'c' || p_partkey AS value {_P} WHERE p_partkey % 2 = 0", "checkKind": f"SELECT 'check/' || p_partkey AS subj, CASE WHEN p_partkey % 3 = 0 THEN 'metric' ELSE 'rule' END AS value {_P}", "expression": f"SELECT 'check/' || p_partkey AS subj, 'x > 1' AS value {_P}", "blocking": f"SELECT 'check/' || p_partkey AS subj, 'true' AS value {_P}",
    "outcomeName": f"SELECT 'outcome/' || p_partkey || '/ok' AS subj, 'ok' AS value {_P} UNION ALL SELECT 'outcome/' || p_partkey || '/fail', 'fail' {_P}", "metricName": f"SELECT DISTINCT 'metric/' || p_partkey % 11 AS subj, 'm' || p_partkey % 11 AS value {_P}",
    "paramName": f"SELECT 'parameter/' || k AS subj, 'p' || k AS value {_PARAMETERS}", "value": f"SELECT 'parameter/' || k AS subj, CAST(k AS STRING) AS value {_PARAMETERS} WHERE k % 3 <> 0",
    "priority": f"SELECT 'transition/' || p_partkey AS subj, '1' AS value {_P} WHERE p_partkey % 2 = 0", "guard": f"SELECT 'transition/' || p_partkey AS subj, 'ready' AS value {_P} WHERE p_partkey % 5 = 0", "toDynamic": f"SELECT 'transition/' || p_partkey AS subj, '$next' AS value {_P} WHERE p_partkey % 3 = 0", "readsStatePath": f"SELECT 'transition/' || p_partkey AS subj, 'state.x' AS value {_P} WHERE p_partkey % 10 = 0",
    "statement": f"SELECT DISTINCT 'invariant/' || p_partkey % 13 AS subj, 'holds ' || p_partkey % 13 AS value {_P}", "exists": f"SELECT 'script/' || p_partkey AS subj, CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END AS value {_P}", "isImplemented": f"SELECT 'step/' || p_partkey AS subj, CASE WHEN p_partkey % 3 = 0 THEN 'true' ELSE 'false' END AS value {_P}",
    "command": f"SELECT 'step/' || p_partkey AS subj, 'run' AS value {_P} WHERE p_size % 5 < 2", "promptRef": f"SELECT 'step/' || p_partkey AS subj, 'prompt' AS value {_P} WHERE p_size % 5 = 2", "reviewPage": f"SELECT 'step/' || p_partkey AS subj, 'page' AS value {_P} WHERE p_size % 5 = 3 AND p_partkey % 9 <> 0",
    "decisionOption": f"SELECT 'step/' || p_partkey AS subj, 'accept' AS value {_P} WHERE p_size % 5 = 3 UNION ALL SELECT 'step/' || p_partkey, 'refuse' {_P} WHERE p_size % 5 = 3", "requiredField": f"SELECT 'step/' || p_partkey AS subj, 'reason' AS value {_P} WHERE p_size % 5 = 3",
}
TABLES = ("region", "nation", "supplier", "part", "lineitem")


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The definitions as a graph whose parts are read when a pattern names them."""

    def part(text: str, tag: str, at: int, name: str) -> DataFrame:
        used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
        rows = spark.sql(text, **used)
        columns = rows.columns[:at] + [tag] + rows.columns[at:]
        return rows.selectExpr("*", f"'{name}' AS {tag}").select(*columns)

    parts = {}
    for table, (texts, tag) in {"nodes": (NODES, "type"), "edges": (EDGES, "rel"), "literals": (LITERALS, "pred")}.items():
        parts[table] = {name: partial(part, text, tag, 1, name) for name, text in texts.items()}
    return Graph(parts=parts, spark=spark)


def _plain(text: str) -> str:
    return text.format(**{t: t for t in TABLES})


def part_of(clause: str) -> str:
    """Rows of one triple in SQL: `f inReport r` is an edge, `f .fieldId param` a value, `c :Component` a node of one of some types."""
    words = clause.split()
    if words[1].startswith(":"):
        return "(" + " UNION ALL ".join(f"SELECT id AS {words[0]} FROM ({_plain(NODES[t])})" for t in words[1][1:].split("|")) + ")"
    if words[1].startswith("."):
        return f"(SELECT subj AS {words[0]}, value AS {words[2]} FROM ({_plain(LITERALS[words[1][1:]])}))"
    return f"(SELECT src AS {words[0]}, dst AS {words[2]} FROM ({_plain(EDGES[words[1]])}))"


def joined(*clauses: str | list, columns: str = "*") -> str:
    """Natural joins of clauses; a list is optional as a whole."""
    out = ""
    for c in clauses:
        optional = isinstance(c, list)
        rows = f"({joined(*c)})" if optional else part_of(c) if len(c.split()) <= 3 else f"({c})"
        out += (" NATURAL LEFT JOIN " if optional else " NATURAL JOIN " if out else "") + rows
    return f"SELECT {columns} FROM {out}"


def _listed(value: str, separator: str) -> str:
    return f"coalesce(array_to_string(list_sort(list(DISTINCT {value}) FILTER ({value} IS NOT NULL)), '{separator}'), '')"


REPORT = "r .reportId param"
RELEASE = (REPORT, "r releasedAs rel", "rel .version version")
STEP = "DeterministicStep|OcrStep|ClaudeStep|HumanStep|TerminalStep"
TOUCHES = " UNION ALL ".join(f"SELECT *, '{d}' AS direction FROM {part_of(f'param {e} artifact')}" for d, e in (("input", "reads"), ("input (optional)", "readsOptional"), ("output", "writes")))
REVISED = ("r hasRevision v", "v .order revision", "v .changedBy by", "v .at at", "v .reason reason", ["v .effectiveFrom effective"])
CHANGED = ("v hasChange c", "c .fact fact", "c .changeKind kind", ["c .previousValue old"], ["c .newValue new"])
STATUS = f"""SELECT param, step, status, "by", "at", note, CASE WHEN step = max(step) OVER (PARTITION BY r) THEN 'yes' END AS current
    FROM (SELECT * REPLACE (CAST(step AS INTEGER) + 1 AS step) FROM ({joined(REPORT, "r hasStatusChange c", "c .order step", "c .lifecycleStatus status", "c .changedBy by", "c .at at", ["c .note note"])}))"""
#: Test obligations of the flow: id, kind, text, step and subject.
TESTS = f"""
    SELECT c || '/test/' || k AS test, k || '_case' AS kind, 'input that the check ' || verb || ': ' || name AS text, s, c AS subject
    FROM ({joined("s hasCheck c", "c .checkId name")}), (VALUES ('pass', 'accepts'), ('fail', 'refuses')) AS x(k, verb)
    UNION ALL SELECT t || '/test/route', 'route', 'on ' || outcome || CASE WHEN guard IS NOT NULL THEN ' if ' || guard ELSE '' END || ' go to ' || coalesce(to_id, dynamic, '?'), s, t
    FROM ({joined("t from s", "t onOutcome o", "o .outcomeName outcome", ["t .guard guard"], ["t .toDynamic dynamic"], ["t to next", "next .stepId to_id"])})
    UNION ALL SELECT DISTINCT i || '/test/' || step_id, 'property', statement, s, i FROM ({joined("i enforcedBy c", "s hasCheck c", "i .statement statement", "s .stepId step_id")})"""
USES = f"""SELECT param, p, NULL AS t, c, 'check' AS via FROM ({joined("param hasCheck c", "c comparedTo p")})
    UNION ALL SELECT param, p, t, NULL, 'transition guard' FROM ({joined("t from param", "t usesParameter p")}) UNION ALL SELECT param, p, NULL, NULL, 'command/action' FROM ({joined(f"param :{STEP}", "param usesParameter p")})"""

SQL = {
    "CQ1": joined("f .fieldId param", "f hasMeaning m", "m .locale locale", "m .definition definition", ["m .label label"], columns="param, f, locale, label, definition"),
    "CQ2": f"SELECT param, substring(s, 9) AS section, purpose, present_when, {_listed('fid', ', ')} AS fields FROM ({joined(REPORT, 'r hasSection s', 's .purpose purpose', 's hasField f', 'f .fieldId fid', ['s .presentWhen present_when'])}) GROUP BY ALL",
    "CQ3": joined(REPORT, "r derivedFrom src", "src .repoUrl source", "src .sha256 sha256", ["src .role role"], ["src .referenceKind reference_kind"], "run usedSource src", "run .flowVersion flow_version", "run .engineVersion engine", "run .result result", ["run .flow flow"], ["run .startedAt started"], ["run hasApproval a", "a .gate gate", "a .decision decision", "a .reviewer reviewer", ["a .at at"]]),
    "CQ4": joined(REPORT, "f inReport r", "f .fieldId fid", "f hasRule ru", "ru .ruleText rule", ["ru .regulatory regulatory"], columns="param, fid, rule, regulatory"),
    "CQ5": f"""SELECT param, fid, status, dataset, "table", "column", type, CASE WHEN type IN ('list', 'series') THEN 'json' ELSE 'value' END AS stored, note
        FROM ({joined(REPORT, "f inReport r", "f .fieldId fid", "f .lineageStatus status", "f .fieldType type", ["f sourcedFrom c", 'c .columnName "column"', "c inTable t", "t .dataset dataset", 't .tableName "table"'], ["f .lineageNote note"])})""",
    "CQ6": joined("c .columnName param", "c inTable t", "t .dataset dataset", 't .tableName "table"', "f sourcedFrom c", "f .fieldId fid", "f .lineageStatus status", "f inReport r", "r .reportId report"),
    "CQ7": joined(REPORT, "r readsTable t", "t .dataset dataset", 't .tableName "table"', ["t inDataSource s", "s .label source", ["s .sourceKind kind"], ["s .database database"]], ["r hasParameter p", "p .label parameter", "p boundToColumn c", 'c .columnName "column"']),
    "CQ8": joined("f .fieldId param", "f inSection s", "f inReport r", "s renderedBy c", ["r releasedAs rel", "rel .version version", ["rel .frozen frozen"]], columns="param, substring(s, 9) AS section, substring(c, 11) AS component, rel, version, frozen"),
    "CQ9": joined("f .fieldId param", "f inReport r", "f inSection s", "r .reportId report", columns="param, report, substring(s, 9) AS section"),
    "CQ10": joined(*RELEASE, "rel hasSchedule s", "s .cadence cadence", "s .runOn run_on", "s .asOfRule as_of", "s .timezone timezone", ["s .calendar calendar"], ["rel .frozen frozen"]),
    "CQ11": joined(*RELEASE, ["rel hasVerificationPolicy v", "v .goldenStaticSsimMin ssim_min", "v .overflowBlocking overflow_blocking", ["v .fidelityMin fidelity_min"]], ["rel hasApprovalPolicy a", "a .sampleRate sample_rate", "a .sampleMin sample_min", ["a .fullReviewAfterRelease full_review"], ["a .reviewerRole reviewer_role"]]),
    "CQ12": f"""SELECT param, parameter, definition, universe, sql, bound_by, path, format, retention, {_listed("value", "|")} AS "values"
        FROM ({joined(REPORT, "r releasedAs rel", "rel hasParameter p", "p .label parameter", ["p .definition definition"], ["p .allowedValue value"], ["p .boundBy bound_by"], ["p universeQuery u", "u .label universe", ["u .sql sql"]], ["rel hasPublishPolicy pub", "pub .pathPattern path", ["pub .publishFormat format"], ["pub .retentionDays retention"]])}) GROUP BY ALL""",
    "CQ13": joined(*RELEASE, *([f"rel .{p} {v}"] for p, v in (("engineVersion", "engine"), ("ontologyVersion", "ontology"), ("libraryVersion", "library"), ("font", "font"), ("fileHash", "file"), ("assetPending", "asset_pending"), ("waiver", "waiver")))),
    "CQ14": f"""SELECT 'all' AS param, report, title, status, kind, coalesce(scheduled, declared) AS cadence, owner, version, frozen, purpose
        FROM ({joined("r :ReportType", "r .reportId report", "r .label title", "r .kind kind", "r .purpose purpose", ["r .cadence declared"], ["r .owner owner"], ["r releasedAs rel", "rel .version version", ["rel .frozen frozen"], ["rel hasSchedule s", "s .cadence scheduled"]])})
        NATURAL LEFT JOIN (SELECT param AS report, status FROM ({STATUS}) WHERE current = 'yes')""",
    "CQ15": f"SELECT a.param, b.param AS other, count(DISTINCT fid) AS shared, {_listed('fid', ', ')} AS fields FROM ({joined(REPORT, 'f inReport r', 'f .fieldId fid')}) a JOIN ({joined(REPORT, 'f inReport r', 'f .fieldId fid')}) b USING (fid) WHERE a.r <> b.r GROUP BY ALL",
    "CQ16": joined("c :Component", "c .label param", "s renderedBy c", "r hasSection s", "r .reportId report", columns="param, report, substring(s, 9) AS section"),
    "CQ17": f"SELECT param, version, deliver_within, failure_rate, run_log, {_listed('alert', '|')} AS alerts FROM ({joined(*RELEASE, 'rel hasObservabilityPolicy o', 'o .deliverWithinHours deliver_within', 'o .maxFailureRate failure_rate', 'o .runLog run_log', ['o .alertRecipient alert'])}) GROUP BY ALL",
    "CQ18": f"""SELECT 'all' AS param, fid, type, count(DISTINCT r) AS reports, min(label) AS label, min(definition) AS definition, any_value(aliases) AS aliases
        FROM ({joined("f .fieldId fid", "f .fieldType type", "f inReport r", "f hasMeaning m", "m .locale locale", "m .definition definition", ["m .label label"])})
        NATURAL LEFT JOIN (SELECT fid, {_listed("alias", "|")} AS aliases FROM ({joined("a .fieldId fid", "a .alias alias")}) GROUP BY ALL) WHERE locale = 'en' GROUP BY fid, type""",
    "CQ19": STATUS,
    "CQ20": joined(REPORT, *REVISED, list(CHANGED), columns="param, CAST(revision AS INTEGER) AS revision, \"at\", \"by\", effective, reason, fact, kind, old, new"),
    "CQ21": f"""SELECT split_part(fact, '.', 2) AS param, report, CAST(revision AS INTEGER) AS revision, "at", effective, "by", reason, fact, kind, old, new
        FROM ({joined("r .reportId report", *REVISED, *CHANGED)}) WHERE fact LIKE 'fields.%' AND split_part(fact, '.', 2) IN (SELECT param FROM {part_of("f .fieldId param")})""",
    "FL01": f"""SELECT * FROM ({joined(f"param :{STEP}", "param .stepId step_id", "param .label name", "param .description description", ["param .usesOcr uses_ocr"], ["param .foreach foreach"])})
        NATURAL JOIN ({" UNION ALL ".join(f"SELECT id AS param, '{t}' AS type FROM ({_plain(NODES[t])})" for t in STEP.split("|"))})""",
    "FL02": joined(TOUCHES, "artifact .path path", "artifact .format format"),
    "FL03": joined("param writes artifact", "artifact hasField f", "f .fieldPath path"),
    "FL04": joined("param hasCheck c", 'c .checkId "check"', "c .checkKind kind", "c .expression expression", "c .blocking blocking", "c onFail o", "o .outcomeName on_fail", ["c measures m", "m .metricName metric"], ["c comparedTo p", "p .paramName parameter", "p .value value"]),
    "FL05": joined("param records m", "m .metricName metric"),
    "FL06": f"SELECT DISTINCT param, parameter, value, via FROM ({joined(USES, 'p .paramName parameter', 'p .value value')})",
    "FL07": joined("param hasCheck c", "i enforcedBy c", "i .statement statement"),
    "FL08": joined(" UNION ALL ".join(f"SELECT *, '{m}' AS mode FROM {part_of(f'param .{p} spec')}" for m, p in (("command", "command"), ("prompt", "promptRef"), ("review page", "reviewPage"))), ["param implementedBy i", "i .path path", 'i .exists "exists"']),
    "FL09": f"SELECT * FROM ({joined('param writes artifact', 'SELECT src AS c, dst AS artifact FROM (' + _plain(EDGES['reads']) + ') UNION SELECT src, dst FROM (' + _plain(EDGES['readsOptional']) + ')', 'c .stepId consumer')}) WHERE c <> param",
    "FL10": f"SELECT DISTINCT * EXCLUDE (direction) FROM ({joined(TOUCHES, 'artifact carries concept', 'concept .label label', 'concept .definition definition')})",
    "FL11": f"""SELECT *, coalesce(to_id, dynamic) AS "to" FROM ({joined("param hasOutcome o", "o .outcomeName outcome", "t from param", "t onOutcome o", ["t .priority priority"], ["t .guard guard"], ["t .toDynamic dynamic"], ["t to next", "next .stepId to_id"])})""",
    "FL12": f"SELECT test, s AS param, kind, text AS description FROM ({TESTS})",
    "FL13": f"SELECT *, 'all' AS param FROM ({joined('t .guard guard', 't .readsStatePath state_path')})",
    "FL14": f"SELECT *, 'all' AS param FROM ({joined('s :HumanStep', 's .stepId step', 's .decisionOption option', 's .requiredField required_field')})",
    "FL15": f"SELECT *, 'all' AS param FROM ({joined('s :DeterministicStep|OcrStep|ClaudeStep', 's .stepId step', 's .isImplemented implemented')})",
    "FL16": f"""WITH found AS (
            SELECT param, s, c AS element, NULL AS c, 'check' AS kind FROM ({joined("c comparedTo param", "s hasCheck c")})
            UNION ALL SELECT param, s, t, NULL, 'transition' FROM ({joined("t usesParameter param", "t from s")})
            UNION ALL SELECT param, s, NULL, NULL, 'step action' FROM ({joined("s usesParameter param", f"s :{STEP}")})
            UNION ALL SELECT param, s, test, c, 'test' FROM ({joined("c comparedTo param", f"SELECT test, subject AS c, s, kind AS k, text AS d FROM ({TESTS})")}))
        SELECT * FROM found NATURAL JOIN {part_of("s .stepId step")}""",
    "FL17": joined(" UNION ALL ".join(f"SELECT src AS s, dst AS param, '{r}' AS role FROM ({_plain(EDGES[e])})" for r, e in (("writer", "writes"), ("reader", "reads"), ("reader (optional)", "readsOptional"))), "s .stepId step"),
}


def _answer(number: int, spark: SparkSession, sf_dir: str) -> DataFrame:
    return (*REPORT_QUESTIONS, *FLOW_QUESTIONS)[number].answer(graph(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f"question_{q.id.lower()}": partial(_answer, k) for k, q in enumerate((*REPORT_QUESTIONS, *FLOW_QUESTIONS))}
ORACLES: dict[str, str] = {f"question_{name.lower()}": sql for name, sql in SQL.items()}
