"""The takeaway run step by step: checks, rewritten and refined forms, by chunk and for the combination."""

import hashlib
import json

from newsloom.operators import chunking
from newsloom.operators import takeaways as tk
from newsloom.plans import runs
from newsloom.profile import Profile

GOOD = " ".join(f"word{i}" + ("." if i % 25 == 24 else "") for i in range(75))  # three sentences, 75 words


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def test_review_of_every_kind(spark):
    rubric = md5(Profile().rubric)
    content = {i: f"Article {i} " + "has some words in it " * 8 for i in range(1, 9)}
    content[1] = "too short"
    content[8] = " ".join(f"Sentence number {i} of a long article stands here." for i in range(40))
    articles = spark.createDataFrame(list(content.items()), "id LONG, content STRING")
    chunks = [r["chunk"] for r in chunking.chunk_articles(articles.where("id = 8"), 200).orderBy("chunk_no").collect()]
    assert len(chunks) > 2
    text = {i: " ".join(c.split()) for i, c in content.items()}
    drafts = {text[2]: GOOD, text[3]: "for AI leaders", text[4]: "x", text[5]: GOOD, text[6]: GOOD + " more.", text[7]: "y"}
    drafts |= {c: f"part {i}." for i, c in enumerate(chunks)}

    def answers(pairs, plain=False):
        rows = [(md5(c), rubric, t if plain else json.dumps({"takeaway": t})) for c, t in pairs]
        return spark.createDataFrame(rows, "content_key STRING, rubric_key STRING, raw STRING")

    combined = " ".join(["part 0.", "new part 1.", *[f"part {i}." for i in range(2, len(chunks))]])
    checks = [(md5(GOOD), True, []), (md5("x"), True, []), (md5("part 0."), True, []), (md5("y"), False, ["names a leader"]),
              (md5("for AI leaders"), False, ["names a leader"]), (md5("about shops"), True, []), (md5(combined), True, [])]
    verdicts = [(5, False, [], ""), (6, True, ["unused"], ""), (2, False, ["Too vague"], "Be exact."), (8, True, [], "")]
    got = runs.run_takeaways(
        articles,
        answers(drafts.items()),
        spark.createDataFrame(verdicts, "id LONG, passes BOOLEAN, issues ARRAY<STRING>, suggestions STRING"),
        answers([(text[2], "refined 2"), (text[3], GOOD), (text[6], GOOD), (combined, "whole. new. one.")]),
        spark.createDataFrame(checks, "takeaway_key STRING, passes BOOLEAN, issues ARRAY<STRING>"),
        answers([(text[3], "  about shops "), (chunks[1], "new part 1."), (text[7], " ")], plain=True),
        max_tokens=200,
    )
    rows = {r["id"]: r for r in got.collect()}
    assert sorted(rows) == list(range(1, 9))

    def state(i):
        r = rows[i]
        return r["takeaway"], r["rewritten"], r["refined"], r["passes_validation"], r["passes_check"]

    assert state(1) == (tk.TOO_SHORT, False, False, False, False)
    assert state(2) == ("refined 2", False, True, False, False)  # the verdict fails it; nobody checked the refined form
    assert state(3) == (GOOD, True, True, True, True)  # rewritten, found too short, refined
    assert state(4) == ("x", False, True, False, True)  # refined form missing: it stays and is judged once more
    assert state(5) == (GOOD, False, False, False, True)  # it fails, but there is nothing to change
    assert state(6) == (GOOD + " more.", False, False, True, False)  # nobody checked it, and there is no other form
    assert state(7) == ("y", False, True, False, False)  # an empty rewritten form is none
    assert state(8) == ("whole. new. one.", False, True, False, False)
    assert any("Word count is 3" in x for x in rows[8]["issues_found"]) and rows[5]["issues_found"] == []


def test_answers_lie_by_one_key_even_if_the_rubric_is_a_constant(spark):
    """Texts of answers are dealt out once for a join, and only those that are asked for when the requests are few."""
    from pyspark.sql import functions as F

    from newsloom.operators import joins

    before = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        data = [("a", 1), ("b", 2), ("b", 3), (None, 4)]
        asked = spark.createDataFrame(data, "content_key STRING, id LONG").withColumn("rubric_key", F.lit("r"))
        given = spark.createDataFrame([("a", "2"), ("a", "1"), ("c", "3"), (None, "4")], "content_key STRING, raw STRING")
        given = given.withColumn("rubric_key", F.lit("r"))
        joined = joins.join_responses(asked, given)
        assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2
        assert {r["id"]: r["raw"] for r in joined.collect()} == {1: "1", 2: None, 3: None, 4: None}
        both = joins.attach_responses(asked, {"raw": given, "other": given.where("raw <> '1'")})
        assert both._jdf.queryExecution().executedPlan().toString().count("Exchange") == 3
        assert {(r["id"], r["raw"], r["other"]) for r in both.collect()} == {(1, "1", "2"), (2, None, None), (3, None, None), (4, None, None)}
        assert sorted(r["raw"] for r in joins.asked_responses(asked, given).collect()) == ["1", "2"]
        parts = spark.range(2000).selectExpr("id % 3 id", "id chunk_no", "'x' takeaway")
        assert tk.combine_takeaways(parts, fan_in=16)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
