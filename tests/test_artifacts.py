"""Suites as text, block lists as tables, rules as files."""

import json

from procflow.operators import artifacts as R
from procflow.plans import graph as G
from procflow.sources import writers

STEP = "doc_id long, sequence int, step_id string, step_type string, action_type string, description string, expected_output string, section string, is_rollback boolean, tags array<string>, commands array<struct<raw: string, vendor: string, protocol: string>>"
MODEL = "doc_id long, document_title string, source_file string, structure string, failure_strategy string"


def test_suite_text(spark):
    steps = [
        (1, 1, "a", "verification", "verify", "Check $x at 100%", "is up", "Pre-checks", False, ["bgp"], [("show ip bgp", "cisco", "bgp")]),
        (1, 2, "b", "action", "execute", "By hand", None, None, False, [], []),
        (1, 3, "c", "info", "observe", "For @all", None, "Pre-checks", False, ["info"], []),
        (1, 4, "d", "rollback", "rollback", "Back", None, "Rollback", True, [], [("no a", "cisco", None), ("no b", "generic", None)]),
        (1, 5, "e", "rollback", "rollback", "Back again", None, "Rollback", True, [], [("no c", "cisco", None)]),
    ]
    models = [(1, "T", "/in/mop.txt", "sections", "rollback_all"), (2, "Empty", None, None, None)]
    got = {r.doc_id: r.suite for r in R.suite_text(spark.createDataFrame(models, MODEL), spark.createDataFrame(steps, STEP), "Shared Keyword").collect()}
    settings, variables, cases, keywords = got[1].split("\n\n\n*** Keywords ***\n")[0].split("\n\n", 2) + [got[1].split("*** Keywords ***\n")[1]]
    assert settings.splitlines()[:5] == ["*** Settings ***", "Documentation    Auto-generated Robot Framework tests for: T", "...              Source: mop.txt", "...              MOP Structure: sections", "...              Failure Strategy: ROLLBACK_ALL"]
    assert settings.splitlines()[-2:] == R.TEARDOWN_BACK.splitlines() and variables.startswith("*** Variables ***\n${HOST}")
    assert cases.splitlines() == [
        "*** Test Cases ***", "", R.RULE, "# Section: Pre-checks", R.RULE,
        "Step_001: Check x at 100", "    [Documentation]    Check $x at 100%", "    [Tags]    verification    bgp    bgp    cisco", "    [Teardown]    Run Keyword If Test Failed    Log Step Failure    Check \\$x at 100%",
        "    ${BASELINE_SHOW_IP_BGP}=    Execute CLI Command    show ip bgp", "    Set Suite Variable    ${BASELINE_SHOW_IP_BGP}", "    Verify Command Output    ${BASELINE_SHOW_IP_BGP}    is up", "",
        "Step_002: By hand", "    [Documentation]    By hand", "    [Tags]    action", "    [Teardown]    Run Keyword If Test Failed    Log Step Failure    By hand", "    Log    MANUAL STEP: By hand    WARN", "",
        "Step_003: For all", "    [Documentation]    For @all", "    [Tags]    info", "    [Teardown]    Run Keyword If Test Failed    Log Step Failure    For \\@all", "    Log    For \\@all    INFO",
    ]
    assert keywords.startswith("Shared Keyword\n\nExecute Rollback Procedure\n")
    assert [x.split("Command    ")[1] for x in keywords.splitlines() if "Execute CLI Command" in x] == ["no c", "no a", "no b"]
    assert got[2].endswith("*** Test Cases ***\n\n\n*** Keywords ***\nShared Keyword") and R.TEARDOWN in got[2] and "Strategy: ABORT" in got[2]


def test_block_list_as_a_table(spark):
    rows = [("reload now", None, "low", False), ("write erase", "write erase", "high", True), ("FORMAT disk", None, None, None), ("show x", None, "low", False), (None, None, "low", False)]
    c = spark.createDataFrame(rows, "raw string, normalized string, blast_radius string, approval_required boolean")
    b = spark.createDataFrame([(3, "re"), (1, "^reload"), (2, "((("), (4, "write"), (5, None), (None, "disk$")], "pattern_no int, pattern string")
    assert {(r.raw, r.pattern_no, r.pattern) for r in G.blocked_by_table(c, b).collect()} == {("reload now", 1, "^reload"), ("FORMAT disk", None, "disk$")}
    assert [(r.pattern_no, bool(r.error)) for r in G.invalid_patterns(b).collect()] == [(2, True)]
    assert G.blocked_by_table(c, b.where("pattern_no = 2")).collect() == []


def test_rules_one_file_a_document(spark, tmp_path):
    rules = spark.createDataFrame([(d, k, f"show {k}") for d in (1, 2) for k in range(3)], "doc_id long, step_sequence int, command string")
    writers.write_rules(rules, str(tmp_path / "r"), apart=True)
    for d in (1, 2):
        (file,) = (tmp_path / "r" / f"doc_id={d}").glob("*.json")
        assert [x["command"] for x in json.loads(file.read_text())["rules"]] == ["show 0", "show 1", "show 2"]
