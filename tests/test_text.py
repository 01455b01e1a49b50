"""Text functions against plain-Python statements of the rules."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from actlens import fixed_values as fv
from actlens.functions import prompts, text


def cleaned(body):
    """The clean-up rules, line by line."""
    kept = []
    for line in body.split("\n"):
        line = re.sub(fv.LIST_MARKER, "", line)
        line = re.sub(fv.LEADING_BOLD, r"\1 ", line)
        line = line.strip().strip("*_")
        if line:
            kept.append(line)
    return "\n\n".join(kept)


CASES = [
    "",
    "plain",
    "1. one\n2) two\n(3) three",
    "- a\n* b\n• c\n– d\n— e\n+ f",
    "iv. roman\nIX) roman\n(a) letter\nB. letter",
    "**Head:** body\n**only bold**",
    "  **Spaced:**   body  \n\n   \n",
    "trailing _\n*starred*\n__under__",
    "b **\n*",
    "-no space\n1.no space",
    " - nbsp bullet \n text ",
    "cr\r\nlf\r\n",
    "line separator **x** y",
    "\x1cfs\x1f",
    "cost $5 \\1 $1\n- $& keep",
]


def test_clean_features_cases(strings):
    assert strings(text.clean_features, CASES) == [cleaned(c) for c in CASES]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.text(alphabet="ab1iv.)(-*_+• \n\t  $\\", max_size=30), min_size=20, max_size=40
    )
)
def test_clean_features_random(strings, values):
    assert strings(text.clean_features, values) == [cleaned(v) for v in values]


def test_extract_tagged(strings):
    values = [
        "<analysis>\n a\nb \n</analysis> tail",
        "<analysis>cut",
        "<analysis></analysis>",
        "x<analysis>1</analysis><analysis>2</analysis>",
        "",
        None,
    ]
    got = strings(text.extract_tagged, values)
    assert got == ["a\nb", None, "", "1", None, None]


def test_extract_explanation(strings):
    values = [
        "<explanation>\n a \n</explanation>",
        "</explanation><explanation>late",
        "</explanation> <explanation>b</explanation>",
        "<explanation>one<explanation>two</explanation></explanation>",
        "none",
        "<explanation></explanation>",
        "é<explanation>ü </explanation>",
    ]
    pattern = re.compile("<explanation>(.*?)</explanation>", re.DOTALL)
    want = [m.group(1).strip() if (m := pattern.search(v)) else None for v in values]
    assert strings(text.extract_explanation, values) == want


def test_explanation_body(strings):
    values = ["<explanation> a </explanation>b", " no tags ", "</explanation>x<explanation>"]
    assert strings(text.explanation_body, values) == ["a", "no tags", values[2]]


def test_wrap_and_extract_are_inverse(strings):
    values = ["a", " padded ", "two\n\nparts", "ünï"]
    back = strings(lambda s: text.extract_explanation(text.wrap_explanation(s)), values)
    assert back == [v.strip() for v in values]


@pytest.mark.parametrize("template", [fv.CRITIC_TEMPLATE, "{{x}} {explanation}", "{explanation}"])
def test_fill_and_unwrap_are_inverse(strings, template):
    values = ["", "a", "$1 \\ {b}", "</text> <summary>", "é"]
    filled = strings(lambda s: text.fill_template(template, explanation=s), values)
    assert filled == [template.format(explanation=v) for v in values]
    back = strings(
        lambda s: text.unwrap_template(text.fill_template(template, explanation=s), template), values
    )
    assert back == values


def test_unwrap_mismatch_fails(strings):
    with pytest.raises(Exception, match="does not fit the template"):
        strings(lambda s: text.unwrap_template(s, fv.CRITIC_TEMPLATE), ["something else"])


@pytest.mark.parametrize("template", ["no field", "{other}", "{explanation:>5}", "{explanation!r}"])
def test_bad_templates(template):
    with pytest.raises(ValueError):
        text.template_parts(template, {"explanation"})


def test_tokens_and_prefixes(strings):
    values = ["", "  lead", "a b\n\nc\td ", "x" * 5000 + " end"]
    assert strings(text.tokenize, values) == [v.split() for v in values]
    assert strings(lambda s: text.tokenize(s, 2), values) == [v.split()[:2] for v in values]
    for n in (1, 2, 9):
        joined = strings(
            lambda s: text.first_words(F.array_join(text.tokenize(s), " "), F.lit(n)), values
        )
        assert joined == [" ".join(v.split()[:n]) for v in values]
        assert joined == strings(lambda s: text.prefix_text(text.tokenize(s), F.lit(n)), values)
    special = strings(lambda s: text.prefix_text(text.tokenize(s), F.lit(4), ["b"]), values)
    assert special[2] == "a c d"


def test_clip_note(strings):
    got = strings(lambda s: text.clip_note(s, 3), ["abc", "abcde", "ééééé"])
    assert got[0] == "abc"
    assert got[1] == "abc\n\n[... TRUNCATED: 2 more chars ...]"
    assert got[2].startswith("ééé\n")


def test_cjk_and_patterns(strings):
    assert strings(text.has_cjk, ["plain é", "㈎", "漢", ""]) == [False, True, True, False]
    found = strings(lambda s: text.matched_patterns(s, ["/tmp/", "iter_"]), ["see /TMP/x iter_3", "no"])
    assert found == [["/tmp/", "iter_"], []]


def test_marker_sites(spark):
    rows = [
        (0, [5, 9, 6, 1]),
        (1, [5, 9, 6, 5, 9, 6]),
        (2, [5, 9, 7]),
        (3, [9, 6, 5, 9]),
        (4, [1, 2, 3]),
        (5, []),
        (6, [9]),
    ]
    df = spark.createDataFrame(rows, "id long, ids array<int>")
    got = df.select("id", prompts.marker_sites(F.col("ids"), 9, 5, 6).alias("s")).orderBy("id")
    assert [r.s for r in got.collect()] == [[1], [1, 4], [], [], [], [], []]


def test_sequences(spark):
    rows = [(0, [1, 1, 0, 0]), (1, [0, 0, 1, 1]), (2, [0, 0]), (3, [1])]
    df = spark.createDataFrame(rows, "id long, m array<int>").orderBy("id")
    got = df.select(prompts.last_real_token(F.col("m")).alias("x")).collect()
    assert [r.x for r in got] == [1, 3, -1, 0]
    tail = df.select(prompts.suffix_check(F.col("m"), [0, 0]).alias("x")).collect()
    assert [r.x for r in tail] == [True, False, True, False]
    mask = spark.range(1).select(prompts.loss_mask(F.lit(2), F.lit(3)).alias("x")).first().x
    assert mask == [0, 0, 1, 1, 1]


def test_prompt_columns(spark):
    df = spark.range(1).select(prompts.user_prompt("say {injection_char}!").alias("p"))
    swapped = df.select(prompts.swap_placeholder(F.col("p"), "X").alias("p"))
    assert swapped.first().p == [("user", "say X!")]
    longer = swapped.select(prompts.append_turn(F.col("p"), "assistant", F.lit("ok")).alias("p"))
    assert [m.role for m in longer.first().p] == ["user", "assistant"]
    with pytest.raises(ValueError):
        prompts.user_prompt("no place")
