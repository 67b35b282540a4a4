from pyspark.sql import functions as F

from helpers import chat, entries, json_of, pairs, records
from parley.operators import validate as va


def codes_of(df):
    rows = df.orderBy("entry_index").collect()
    return [[d["code"].split(".")[1] for d in r["diagnostics"]] for r in rows]


def chatml(spark, *items):
    return codes_of(va.analyze_chatml(entries(spark, items)))


def test_clean_entry_has_no_findings(spark):
    assert chatml(spark, chat("Hi", "Hello there.")) == [[]]


def test_top_level_faults(spark):
    good = chat("Hi", "Hello.")
    got = chatml(
        spark,
        "5",
        {"messages": good["messages"]},
        {"messages": good["messages"], "tags": "x"},
        {"messages": good["messages"], "tags": [1, "a", " ", None, {"z": 1}]},
        {**good, "zeta": 1, "alpha": 2, "id": 3, "metadata": {}, "source": "s"},
        {"tags": []},
        {"messages": {"a": 1}, "tags": []},
    )
    assert got == [
        ["not_dict"],
        ["missing_tags"],
        ["tags_not_list"],
        ["invalid_tag_value", "empty_tag", "invalid_tag_value", "invalid_tag_value"],
        ["unknown_top_level_key", "unknown_top_level_key"],
        ["missing_messages"],
        ["messages_not_list"],
    ]


def test_unknown_keys_are_sorted_and_carry_their_value(spark):
    df = va.analyze_chatml(entries(spark, [{**chat("Hi", "Yo."), "zeta": [1], "alpha": None}]))
    d = df.first()["diagnostics"]
    assert [(x["path"], x["original_value"]) for x in d] == [(["alpha"], "null"), (["zeta"], "[1]")]


def test_early_exits(spark):
    sys = {"role": "system", "content": "s"}
    user, answer = {"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}
    wrap = lambda *m: {"messages": list(m), "tags": []}
    assert chatml(spark, wrap(sys, user), wrap(sys, user, answer, user), wrap("x", user, answer), wrap(sys, sys)) == [
        ["insufficient_messages"],
        ["incomplete_exchanges"],
        ["system_not_dict"],
        ["duplicate_system_message", "insufficient_messages"],
    ]


def test_roles_by_position(spark):
    def roles(*rs):
        return {"messages": [{"role": r, "content": "text"} for r in rs], "tags": []}

    got = chatml(
        spark,
        roles("SYS", "human", "GPT"),
        roles("user", "user", "assistant"),
        roles("system", "assistant", "user"),
        roles("system", "Emma", "assistant", " emma ", "assistant"),
        roles("system", None, "assistant"),
        roles("system", "user", 7),
    )
    assert got == [
        ["role_canonicalization"] * 3,
        ["missing_system_role"],
        ["wrong_role", "wrong_role"],
        ["wrong_role"],
        ["wrong_role"],
        ["wrong_role"],
    ]


def test_content_checks(spark):
    got = chatml(
        spark,
        chat("Hi", "", system=" "),
        chat(" Hi ", "As an AI language model, I won't."),
        chat("Hi", "**bold** text"),
        chat("Hi", "# Title\nmore"),
        chat("Hi", 'see {"a": 1}'),
        chat("Hi", "see <DIV>"),
        {"messages": [{"role": "system", "content": "s"}, {"role": "user"}, {"role": "assistant", "content": 5}], "tags": []},
    )
    assert got == [
        ["content_whitespace", "empty_system_content", "empty_content"],
        ["content_whitespace", "ai_refusal_language"],
        ["formatting_leakage"],
        ["formatting_leakage"],
        ["formatting_leakage"],
        ["formatting_leakage"],
        ["empty_content", "empty_content"],
    ]


def test_split_candidate_by_exchanges_or_words(spark):
    long_answer = "word " * 2000 + "word"
    assert chatml(spark, chat(*["a", "b"] * 8), chat("a", long_answer), chat(*["a", "b"] * 7)) == [
        ["split_candidate"], ["split_candidate"], []
    ]


def test_repair_leaves_no_automatic_finding(spark):
    bad = [
        {"messages": [{"role": "SYS", "content": " s "}, {"role": "human", "content": "u"}, {"role": "bot", "content": "a "}], "tags": ["", 1, "t"]},
        {"messages": chat("a", "b")["messages"]},
        {"messages": chat("a", "b")["messages"], "tags": 4},
    ]
    fixed = va.repair_chatml(entries(spark, bad))
    assert [r["changed"] for r in fixed.collect()] == [True] * 3
    left = va.analyze_chatml(fixed.drop("changed"))
    assert left.where(F.exists("diagnostics", lambda d: d["repair_kind"] == "automatic")).count() == 0
    assert json_of(fixed)[0] == {
        "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}],
        "tags": ["t"],
    }


def test_repair_of_one_code_keeps_the_rest(spark):
    item = {**chat("a", "b"), "tags": ["", 1, "t", {"k": None}]}
    fixed = va.repair_chatml(entries(spark, [item]), only=("base.empty_tag",))
    assert json_of(fixed)[0]["tags"] == [1, "t", {"k": None}]


def test_short_entries_are_not_repaired(spark):
    item = {"messages": [{"role": "human", "content": " x "}], "tags": []}
    fixed = va.repair_chatml(entries(spark, [item]))
    assert pairs(fixed) == [[("human", " x ")]]


def test_summary_can_ignore_tag_faults(spark):
    df = va.analyze_chatml(entries(spark, [{"messages": chat("a", "b")["messages"]}, chat("a", "b")]))
    loud = va.diagnostic_summary(df).first()
    quiet = va.diagnostic_summary(df, tag_faults_block=False).first()
    assert (loud["entries_with_errors"], quiet["entries_with_errors"]) == (1, 0)
    assert loud["valid_entries"] == quiet["valid_entries"] == 1
    assert loud["error_count"] == quiet["error_count"] == 1


def test_sharegpt_findings(spark):
    share = lambda *t, **k: {"conversations": list(t), "tags": [], **k}
    ok = {"from": "human", "value": "v"}
    system = {"from": "system", "value": "s"}
    got = codes_of(
        va.analyze_sharegpt(
            records(
                spark,
                [
                    share(system, ok, {"from": "gpt", "value": "a"}, title="t", model="m"),
                    {"tags": []},
                    {"conversations": 4, "tags": []},
                    share(),
                    share(system, 5, {"value": "x"}, {"role": "user"}, {"speaker": "Emma", "text": ""}, {"from": "User ", "content": "c"}),
                    share(ok),
                    share(system, {"role": "sys", "value": "b"}),
                ],
            )
        )
    )
    assert got == [
        [],
        ["missing_conversations"],
        ["conversations_not_list"],
        ["empty_conversations"],
        ["turn_not_dict", "missing_role_field", "role_variant", "missing_content_field", "unknown_role", "empty_content", "role_variant"],
        ["no_system_turn"],
        ["role_variant", "multiple_system_turns"],
    ]
