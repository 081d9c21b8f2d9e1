"""The gate of many patterns is open wherever one of them is found."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import topic_values as V
from tidemark.functions import topics
from tidemark.functions.gates import begun, gate, openers

SAID = ("", "a law.", "outlaw", "CVE-2026-1", "x-zero day", "zero-day", "the SRE team", "AIs", "an AI", "大模型", "RISC-V", "Kubernetes outage", "javascripts", "go", "Go 1.2", "relaw banana", "engineers lose touch", "data centre", "é law", "thelaw")


def _read(pattern):
    return re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), pattern))


@pytest.mark.parametrize("rules", [V.CATEGORY_RULES, V.TAG_RULES])
def test_gate(rules):
    patterns = topics._patterns(rules)
    whole = _read(gate(patterns))
    for text in SAID:
        found = any(re.search(p, text, re.IGNORECASE) for p in patterns)
        assert whole.search(text.lower()) or not found
    assert not whole.search("the relawed ones thebanana aix")


def test_gate_of_what_has_no_beginning():
    assert gate((r".x", "law")) is None
    assert gate((r"\blaws?\b",)) == "(?<![a-z0-9])(?:l(?:aw|aws))(?![a-z0-9])"


def test_a_sign_begins_with_what_opens_it(spark):
    signs = topics._SIGNS
    words = [w for p in signs for w in re.split(r"[|()?:\\^$\[\]{}.*+]+", p) if len(w) > 1]
    rng = random.Random(4)
    said = [*SAID, "", *[rng.choice(("", "x", " ", "é", "中", "_")).join(rng.choices([*words, "-", "a", "é ", "2"], k=rng.randint(1, 5))) for _ in range(600)]]
    rows = spark.createDataFrame(list(enumerate(t.lower() for t in said)), "k int, low string")
    found = {r["k"]: set(r["begun"]) for r in rows.select("k", begun(F.col("low"), signs).alias("begun")).collect()}
    n = 0
    for k, text in enumerate(said):
        for sign in signs:
            if re.search(sign, text.lower(), re.IGNORECASE):
                n += 1
                assert found[k] & set(openers((sign,), signs)), (text, sign)
    assert n > 500 and not found[0]
    assert found[SAID.index("an AI")] == {"ai"} and not found[SAID.index("outlaw")]
    assert openers((r".x",), (r".x", "law")) is None


def test_a_sign_is_sought_only_where_a_beginning_is(spark):
    """A text with a single beginning was searched for every sign."""
    df = spark.createDataFrame([("a", "an AI")], "title string, evidence string")
    plan = topics.assigned(df)._jdf.queryExecution().optimizedPlan().toString()
    for c in ("title", "evidence"):
        sought = len(re.findall(rf"RLIKE\(_low_{c}#\d+, \(\?U\)", plan))
        assert sought == len(re.findall(rf"arrays_overlap\(_begun_{c}#\d+, \[[^\]]*\]\) AND RLIKE\(_low_{c}#\d+, \(\?U\)", plan)) > 50
