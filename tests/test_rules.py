"""Filters, scoring, ranking and takeaway rules on literal rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from newsloom import profile as p
from newsloom.operators import aggregates, filters, joins, ranking, requests, responses, scoring
from newsloom.operators import takeaways as tk
from newsloom.profile import Profile

ARTICLE = "id LONG, title STRING, content STRING, takeaway STRING"


def test_specific_articles(rows):
    df = rows(
        [
            ("My Article", "https://example.com/a"), ("About", "https://example.com/about"),
            ("AI", "https://example.com/category/artificial-intelligence/"), ("AI", "https://example.com/tag/ai/"),
            ("Abcde", "https://example.com/x"), ("Ab", "https://example.com/x"), ("A b", "https://example.com/x"),
            (None, "https://example.com/x"), ("Two words", "https://example.com/TOPICS/x"),
            ("Two words", "https://example.com/aboutface"), ("Two words", "https://example.com/tag/ai/more"),
        ],
        "title STRING, url STRING",
    )
    kept = [(r["title"], r["url"].rsplit("example.com", 1)[1]) for r in filters.filter_specific_articles(df).collect()]
    assert kept == [
        ("My Article", "/a"), ("Abcde", "/x"), ("A b", "/x"), ("Two words", "/aboutface"), ("Two words", "/tag/ai/more"),
    ]


def test_topic_titles(rows):
    titles = {
        "New AI tool": True, "ai": True, "AI-powered shop": True, "gen-AI": True, "retail": False, "Said": False,
        "Deep Learning wins": True, "deeplearning": False, "The LLM": True, "llms": False, "éai": False, "ai_x": False,
    }
    kept = {r[0] for r in filters.filter_topic_titles(rows([(t,) for t in titles], "title STRING")).collect()}
    assert kept == {t for t, keep in titles.items() if keep}


def test_timeframe(rows):
    df = rows([("2024-01-02",), ("2024-01-01",), ("2023-12-31",), ("bad-date",), (None,)], "date STRING")
    assert [r[0] for r in filters.filter_recent_days(df, "2024-01-01").collect()] == ["2024-01-02", "2024-01-01"]
    stamped = df.withColumn("published_ts", F.col("date").try_cast("timestamp"))
    assert [r[0] for r in filters.filter_recent(stamped, "2024-01-01").collect()] == ["2024-01-02"]
    assert filters.filter_recent(stamped, "2024-01-01", inclusive=True).count() == 2


def test_relevance_gate(rows):
    df = rows([(45, "AI term found"), (10, ""), (40, "x"), (50, ""), (39, "x")], "ai_confidence INT, ai_validation STRING")
    assert [r[0] for r in filters.filter_relevant(df).collect()] == [45, 40]


def test_consent_and_failures(rows):
    df = rows([("Please ACCEPT COOKIES now",), ("nothing",)], "content STRING")
    assert [r["is_consent_page"] for r in filters.filter_consent_pages(df).collect()] == [True, False]
    texts = rows([(t,) for t in (*p.FAILED_TAKEAWAYS, "fine")], "takeaway STRING")
    assert [r[0] for r in filters.drop_failed_takeaways(texts).collect()] == ["fine"]


SEVEN = (
    "Walmart deployed ChatGPT across retail stores and increased sales by 20% while Google launched a shopping update"
)


@pytest.mark.parametrize(
    "content, met, assessment, score",
    [
        (SEVEN, 7, "INCLUDE", 116),
        (SEVEN + " with its grown staff", 6, "INCLUDE", 100),  # 'own' inside 'grown'
        ("the weather is fine", 1, "CUT", 16),
        ("an article about retail with proud partners", 1, "CUT", 16),
        ("Kroger deployed a system for retail", 3, "OK", 50),
        # five without retail relevance
        ("OpenAI launched ChatGPT with improved efficiency", 5, "CUT", 83),
    ],
)
def test_evaluation(rows, content, met, assessment, score):
    df = scoring.criteria_score(scoring.evaluate_articles(rows([(1, "", content, "")], ARTICLE)))
    row = df.first()
    assert (row["criteria_met"], row["assessment"], row["assessment_score"]) == (met, assessment, score)


def test_entities_and_tools(rows):
    cases = [
        ("Nvidia beats amazon", "Amazon", None),  # list order, not text order
        ("the Federal Trade Commission rules on llm use", "Federal Trade Commission", "Generative AI"),
        ("Metal and metaverse", "Metal", None),
        ("lower case only", None, None),
        ("Crocs tries gpt-4 and Gemini", "Crocs", "Gemini"),
        ("A B & Co", "Co", None),
    ]
    df = rows([(i, "", c[0], "") for i, c in enumerate(cases)], ARTICLE)
    found = scoring.find_tools(scoring.find_entities(df)).orderBy("id").collect()
    assert [(r["entity"], r["tool"]) for r in found] == [c[1:] for c in cases]


def test_criteria_rows(rows):
    df = scoring.explode_criteria(scoring.evaluate_articles(rows([(1, "", SEVEN, "")], ARTICLE)))
    listed = df.orderBy("criterion_no").collect()
    assert [r["mark"] for r in listed] == ["✓"] * 7
    assert listed[0]["notes"] == "Google using ChatGPT"
    assert listed[1]["notes"] == "ChatGPT is an external, open-source model"


@pytest.mark.parametrize(
    "title, content, takeaway, confidence, reason",
    [
        ("New AI breakthrough", "", "", 50, "AI term 'ai' found in title"),
        ("New AI breakthrough", "", "about an llm", 80, "AI term 'llm' found in article takeaway"),
        ("Shoes", "gpt " * 5, "", 40, "Multiple AI references (5) found in content"),
        ("Shoes", "chatgpt " * 3, "", 40, "Multiple AI references (6) found in content"),
        ("Shoes", "gpt " * 5, "llm", 70, "AI term 'llm' found in article takeaway"),
        ("Shoes", "gpt " * 4, "llm", 30, "AI term 'llm' found in article takeaway"),
        ("Shoes", None, None, 0, "Not explicitly about AI"),
    ],
)
def test_relevance(rows, title, content, takeaway, confidence, reason):
    row = scoring.score_relevance(rows([(1, title, content, takeaway)], ARTICLE)).first()
    assert (row["ai_confidence"], row["ai_validation"]) == (confidence, reason)


def test_relevance_counts_whole_text_unless_told(rows):
    df = rows([(1, "Shoes", "x" * 5000 + " gpt" * 5, "")], ARTICLE)
    assert scoring.score_relevance(df).first()["ai_confidence"] == 40
    assert scoring.score_relevance(df, first_chars=5000).first()["ai_confidence"] == 0


def test_report_relevance(rows):
    df = rows(
        [
            ("2024-01-31", 50, "x" * 51, ["a", "b", "c"]), ("2024-01-30", 50, "x" * 50, None),
            ("2024-02-02", 0, None, []), (None, 0, "", []), ("bad", 100, "", []), ("2023-01-01", 10, "", []),
        ],
        "date STRING, ai_confidence INT, takeaway STRING, key_points ARRAY<STRING>",
    )
    scores = [r["relevance_score"] for r in scoring.report_relevance(df, "2024-01-31").collect()]
    assert scores == pytest.approx([75.0, 53.5, 33.0, 0.0, 50.0, 5.0])


def test_sorting_and_selection(rows):
    schema = "url STRING, assessment STRING, assessment_score INT, date STRING, relevance_score DOUBLE"
    data = [
        ("a", "CUT", 116, "2024-01-01", 1.0), ("b", "OK", 50, "2024-01-02", 2.0), ("c", None, 116, "bad", 3.0),
        ("d", "INCLUDE", 83, None, 4.0), ("e", "INCLUDE", 83, "2024-01-03", 4.0), ("f", "ODD", None, "2024-01-03", 9.0),
    ]
    df = rows(data, schema)
    assert [r["url"] for r in ranking.sort_by_assessment(df).collect()] == ["d", "e", "b", "a", "c", "f"]
    ranks = {r["url"]: r["rank"] for r in ranking.rank_report(df).collect()}
    assert ranks == {"d": 1, "e": 2, "b": 3, "a": 4, "c": 5, "f": 6}
    top = [r["url"] for r in ranking.select_top_articles(df, "2024-01-31", 3).collect()]
    assert top == ["d", "e", "f"]
    many = df.limit(1).crossJoin(df.sparkSession.range(11)).withColumn("url", F.col("id").cast("string"))
    assert ranking.select_top_articles(many, "2024-01-31").count() == 10


def test_similarity(rows):
    df = rows(
        [
            ([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0]),
            ([3.0, 4.0], [1.0, 0.0]), ([1.0, 0.0, 5.0], [1.0, 0.0]), ([], []),
        ],
        "a ARRAY<FLOAT>, b ARRAY<FLOAT>",
    )
    # 0.6 -> 6; the longer vector is cut for the product but not for its norm
    assert [r["similarity"] for r in scoring.similarity_score(df, "a", "b").collect()] == [10, 1, 1, 1, 6, 2, 1]


def test_half_points_round_to_even(rows):
    df = rows([([9.0, 0.0], 0.45), ([1.0], 0.55), ([1.0], 0.65)], "a ARRAY<DOUBLE>, c DOUBLE")
    rounded = df.select(F.bround(F.col("c") * 10).cast("int").alias("r")).collect()
    assert [r["r"] for r in rounded] == [round(4.5), round(5.5), round(6.5)]


def test_categories(rows):
    cases = [
        ("warehouse and logistics", "Supply Chain, Distribution & Logistics"),
        ("nothing fits here", "Other Applications"),
        ("Nike tests an llm in its warehouse", "Competitor Updates"),
        ("Nike opens a warehouse", "Supply Chain, Distribution & Logistics"),
        ("dashboard design", "Business Intelligence (BI)"),  # tie goes to the lower number
    ]
    df = rows([(i, "", c, "") for i, (c, _) in enumerate(cases)], ARTICLE)
    assert [r["category"] for r in scoring.categorize_by_terms(df).orderBy("id").collect()] == [c[1] for c in cases]


def test_label_relevance(rows):
    df = rows(
        [("Retail news", "x"), ("Shoes", "Found potential AI article: s"), ("Shoes", None)],
        "title STRING, _source_log STRING",
    )
    reasons = [r["reason"] for r in scoring.label_relevance(df, log="_source_log").collect()]
    assert reasons == [
        "Direct AI mention in title: Retail news", "Identified as potential AI article during initial scan",
        "Passed initial AI content scan",
    ]


def takeaway(words, sentences, extra=""):
    body = ["word"] * words
    step = words // sentences
    for i in range(sentences):
        body[min((i + 1) * step, words) - 1] += "."
    return " ".join(body) + extra


@pytest.mark.parametrize("words, sentences, ok", [
    (69, 3, False), (70, 3, True), (90, 4, True), (91, 4, False), (80, 2, False), (80, 5, False),
])
def test_takeaway_size(rows, words, sentences, ok):
    row = tk.validate_takeaways(rows([(takeaway(words, sentences),)], "takeaway STRING")).first()
    assert (row["word_count"], row["sentence_count"], row["passes_validation"]) == (words, sentences, ok)


@pytest.mark.parametrize("extra", [" a-b", " *", " 1.", " a)", " •"])
def test_takeaway_list_marks(rows, extra):
    row = tk.validate_takeaways(rows([(takeaway(80, 3, extra),)], "takeaway STRING")).first()
    assert tk.LIST_ISSUE in row["issues_found"]


@pytest.mark.parametrize("phrase", [
    "This update is crucial for AI executives in retail to leverage.", "retail AI leaders", "AI leader in retail",
    "for AI leaders", "AI leadership", "retail executive", "industry leaders", "the retail leader", "retail leaders",
    "the target audience", "your target reader", "leaders in AI", "leader concerned with", "insights for all leaders",
    "relevant to every leader", "leaders can leverage", "that some leaders can", "tools that help leaders",
    "enabling a leader", "helping leaders", "assisting those leaders", "for many leaders to", "leaders to leverage",
    "leaders should", "leader need", "leaders must",
])
def test_takeaway_audience(rows, phrase):
    row = tk.validate_takeaways(rows([(phrase,)], "takeaway STRING")).first()
    assert tk.AUDIENCE_ISSUE in row["issues_found"] and not row["passes_validation"]


def test_takeaway_without_audience(rows):
    for phrase in ("a leader of men", "cheerleaders should", "the misleaders"):
        row = tk.validate_takeaways(rows([(phrase,)], "takeaway STRING")).first()
        assert tk.AUDIENCE_ISSUE not in row["issues_found"]


VERDICT = "id LONG, passes BOOLEAN, issues ARRAY<STRING>, suggestions STRING"


def test_verdicts_and_refinement(rows):
    good, short = takeaway(80, 3), "Too short."
    texts = rows([(1, good), (2, good), (3, good), (4, short), (5, short), (6, good)], "id LONG, takeaway STRING")
    verdicts = rows(
        [
            (2, True, [], "Tighten it."), (3, False, ["Vague"], ""), (4, False, ["Vague"], "Add facts."),
            (6, False, [], ""),
        ],
        VERDICT,
    )
    merged = tk.refinement_instructions(tk.merge_verdicts(tk.validate_takeaways(texts), verdicts))
    got = {r["id"]: (r["passes_validation"], r["issues_found"], r["refinement"]) for r in merged.collect()}
    intro = "Please address the following issues:\n"
    sized = ["Sentence count is 1, should be 3-4.", "Word count is 2, should be 70-90 words."]
    bullets = "".join(f"- {i}\n" for i in sized)
    assert got[1] == (True, [], tk.ALL_CLEAR)  # no verdict: the rules alone
    assert got[2] == (True, [], tk.ALL_CLEAR)
    assert got[3] == (False, ["Vague"], intro + "- Vague")
    assert got[4] == (
        False, sized + ["Vague"],
        intro + bullets + "- Vague\nAdditionally, consider these qualitative improvements:\nAdd facts.",
    )
    assert got[5] == (False, sized, (intro + bullets).strip())
    assert got[6] == (False, [], tk.ALL_CLEAR)


def test_audience_check_fails_closed(rows):
    texts = rows([(1,), (2,), (3,)], "id LONG")
    verdicts = rows([(1, True, [], ""), (2, False, ["Leaders"], "")], VERDICT)
    got = {r["id"]: (r["passes_check"], r["check_issues"]) for r in tk.audience_check(texts, verdicts).collect()}
    assert got == {1: (True, []), 2: (False, ["Leaders"]), 3: (False, [tk.CHECK_FAILED])}


@pytest.mark.parametrize("before, after", [
    ("5G and 3x", "5 G and 3 x"), ("$ 5 now", "$5 now"), ("$ 1 . 5 million", "$1.5 million"),
    ("200 000 users", "200,000 users"), ("1 , 2 and 3 . 4", "1,2 and 3.4"), ("a , b .", "a, b."),
    ("a" * 26, "a" * 20 + " " + "a" * 6), ("1" * 26, "1" * 26), ("a" * 25, "a" * 25), ("  x \n y ", "x y"),
    ("GPT4", "GPT 4"),
])
def test_clean_up(rows, before, after):
    assert tk.clean_takeaways(rows([(before,)], "takeaway STRING")).first()[0] == after


def test_clean_up_enters_a_pattern_at_one_character(rows):
    """Most places of a text are passed over after one character, and what is replaced is what the plain patterns replace."""
    assert all(re.match(r"(\(\?U\))?(\(\?=\\d\)|\\\$| )", pattern) for pattern, _ in tk._SPACING)
    plain = (
        (r"(?U)(\d+)([a-zA-Z])", "$1 $2"), (r"(?U)([a-zA-Z])(\d)", "$1 $2"), (r"(?U)\$ *(\d+)", r"\$$1"),
        (r"(?U)\$ *(\d+) *\. *(\d+)", r"\$$1.$2"), (r"(?U)(\d+) +(\d{3})", "$1,$2"), (r"(?U)(\d+) *, *(\d+)", "$1,$2"),
        (r"(?U)(\d+) *\. *(\d+)", "$1.$2"), (r" +([.,!?:;])", "$1"),
    )
    rng = random.Random(5)
    data = [("".join(rng.choices("aZ1207 ,.$!é\u0663\U0001d7d9\n", k=rng.randrange(40))),) for _ in range(3000)]
    spaced = rows(data, "x STRING").select(tk._rewrite(F.col("x"), tk._SPACING).alias("a"), tk._rewrite(F.col("x"), plain).alias("b"))
    assert spaced.where("a <> b").count() == 0


def test_short_content(rows):
    df = rows([("x" * 99,), ("x" * 100,), (None,)], "content STRING")
    assert [r["takeaway"] for r in tk.short_content_guard(df).collect()] == [tk.TOO_SHORT, None, tk.TOO_SHORT]


def test_extraction_prefers_telling_sentences(rows):
    body = "It rained. Walmart uses ChatGPT. Nothing. Sales rose 20%. Fine day. Amazon deployed Claude. Revenue grew. End."
    row = tk.extractive_takeaways(rows([(1, "", body, "")], ARTICLE)).first()
    assert row["takeaway"] == "Walmart uses ChatGPT. Sales rose 20%. Amazon deployed Claude. Revenue grew."


RESPONSES = [
    ('{"takeaway": "Good."}', "Good."), (' {"takeaway": "A \\"quoted\\" one"}\n', 'A "quoted" one'), ('{"other": 1}', ""),
    ('{"takeaway": "never closed', "never closed"), ('{"takeaway": "closed" but broken', "closed"),
    ("{\"takeaway\": 'single', }", "single"), ("not json", responses.NO_TAKEAWAY), (None, responses.NO_TAKEAWAY),
    ("", responses.NO_TAKEAWAY), ("[1, 2]", responses.NOT_AN_OBJECT), ('{"takeaway": "", broken', ""),
]


@pytest.mark.parametrize("raw, want", RESPONSES)
def test_takeaway_responses(rows, raw, want):
    assert responses.parse_takeaway_responses(rows([(raw,)], "raw STRING")).first()["takeaway"] == want


def test_takeaway_response_fallback_column(rows):
    df = rows([("junk", "joined text"), ('{"takeaway": "ok"}', "joined text")], "raw STRING, joined STRING")
    got = [r["takeaway"] for r in responses.parse_takeaway_responses(df, fallback="joined").collect()]
    assert got == ["joined text", "ok"]


@pytest.mark.parametrize("raw, want", [
    ('{"category": "C", "justification": "J"}', ("C", "J")),
    ('```json\n{"category": "C", "justification": "J"}\n```', ("C", "J")),
    ('{"category": "C"}', ("Uncategorized", responses.FORMAT_ERROR)),
    ('{"category": ', ("Uncategorized", responses.DECODE_ERROR)),
    (None, ("Uncategorized", responses.NO_RESPONSE)),
])
def test_category_responses(rows, raw, want):
    row = responses.parse_category_responses(rows([(raw,)], "raw STRING")).first()
    assert (row["category"], row["category_justification"]) == want


@pytest.mark.parametrize("raw, want", [
    ('{"keywords": ["a", "b", "c", "d", "e", "f"]}', ["a", "b", "c", "d", "e", "f"]), ('{"keywords": []}', []),
    ('{"x": 1}', []), ("broken", list(p.FALLBACK_KEYWORDS)), (None, list(p.FALLBACK_KEYWORDS)),
])
def test_keyword_responses(rows, raw, want):
    assert responses.parse_keyword_responses(rows([(raw,)], "raw STRING")).first()["keywords"] == want


def test_requests_carry_the_rubric(rows):
    df = rows([(1, "T", "word " * 30, "K")], ARTICLE)
    first = requests.build_requests(df, "takeaway", Profile(rubric="RUBRIC_ONE")).first()
    second = requests.build_requests(df, "combine", Profile(rubric="RUBRIC_TWO")).first()
    assert "RUBRIC_ONE" in first["prompt"] and "RUBRIC_TWO" in second["prompt"]
    assert first["rubric_key"] != second["rubric_key"] and first["content_key"] == second["content_key"]
    assert '{"takeaway": "..."}' in first["prompt"]


def test_requests_carry_whole_texts_and_chunk_numbers(rows):
    df = rows([(1, "T", "x" * 130_000, "K")], ARTICLE).withColumn("refinement", F.lit("R"))
    for kind in ("categorize", "takeaway", "rationale", "validate", "refine", "rewrite", "combine"):
        assert "x" * 130_000 in requests.build_requests(df, kind).first()["prompt"], kind
    short = requests.build_requests(df, "takeaway", template="{snippet}", max_chars=10).first()["prompt"]
    assert short == "x" * 10 + "..."
    chunks = rows([(1, 0, "a"), (1, 1, "b")], "id LONG, chunk_no INT, content STRING")
    got = requests.build_requests(chunks, "takeaway", template="{snippet}").collect()
    assert sorted((r["chunk_no"], r["prompt"]) for r in got) == [(0, "a"), (1, "b")]


def test_responses_join_by_fingerprints(rows):
    asked = requests.build_requests(rows([(1, "", "same", ""), (2, "", "same", ""), (3, "", "b", "")], ARTICLE), "takeaway")
    given = asked.where("id = 1").select("content_key", "rubric_key", F.lit("R").alias("raw"))
    got = {r["id"]: r["raw"] for r in joins.join_responses(asked, given).collect()}
    assert got == {1: "R", 2: "R", 3: None}


def test_joins(rows):
    links = rows([("u1", "t"), ("u2", "t"), ("u3", "t")], "url STRING, title STRING")
    meta = rows([("u1", "Page", "2024-01-01"), ("u1", "Page", "2024-01-02"), ("u2", None, "2024-01-01")],
                "url STRING, title STRING, date STRING")
    assert [(r["url"], r["date"]) for r in joins.join_metadata(links, meta).collect()] == [("u1", "2024-01-01")]
    filled = joins.join_content(
        rows([("a", "kept"), ("b", ""), ("c", None)], "url STRING, content STRING"),
        rows([("a", "x"), ("b", "new")], "url STRING, content STRING"),
    )
    assert {r["url"]: r["content"] for r in filled.collect()} == {"a": "kept", "b": "new", "c": None}
    assert joins.exclude_seen(links, rows([("u2",), ("u2",)], "url STRING")).count() == 2


def test_funnel_and_summary(rows):
    df = rows(
        [("c", 50, "r"), ("", 50, "r"), (None, 50, "r"), ("c", 30, "r"), ("c", 40, "")],
        "content STRING, ai_confidence INT, ai_validation STRING",
    )
    assert tuple(aggregates.funnel_counts(df).first()) == (5, 3, 1, 1, True)
    empty = aggregates.funnel_counts(df.where("false")).first()
    assert tuple(empty) == (0, 0, 0, 0, False)
    summary = aggregates.source_scan_summary(
        rows([("a",), ("b",), ("c",)], "url STRING"), rows([("a",), ("b",)], "url STRING"),
        rows([("a",), ("a",)], "source STRING"),
    )
    assert {tuple(r) for r in summary.collect()} == {("a", True, 2), ("b", True, 0), ("c", False, 0)}


@pytest.mark.parametrize("raw, want", [
    ('{"category": 5, "justification": null}', ("5", None)),
    ('{"category": "a", "category": "b", "justification": "c"}', ("b", "c")),
    ('{"category": "a"}', (responses.UNCATEGORIZED, responses.FORMAT_ERROR)),
    ('[1]', (responses.UNCATEGORIZED, responses.FORMAT_ERROR)),
    ('{"category": "a", ', (responses.UNCATEGORIZED, responses.DECODE_ERROR)),
    (None, (responses.UNCATEGORIZED, responses.NO_RESPONSE)),
])
def test_category_keys_may_hold_null_or_repeat(rows, raw, want):
    assert tuple(responses.parse_category_responses(rows([(raw,)], "raw STRING")).drop("raw").first()) == want


def test_repeated_takeaway_keeps_the_last(rows):
    df = rows([('{"takeaway":"a","takeaway":"b"}',)], "raw STRING")
    assert responses.parse_takeaway_responses(df).first()["takeaway"] == "b"


def test_fresh_responses(rows):
    asked = rows([(1, "k", "r"), (2, "x", "r")], "id LONG, content_key STRING, rubric_key STRING")
    given = rows([("k", "r", "old", "2024-01-01"), ("k", "r", "new", "2024-01-09"), ("k", "r", "late", "2024-02-01"),
                  ("x", "r", "stale", "2023-12-01")], "content_key STRING, rubric_key STRING, raw STRING, d STRING")
    given = given.select("content_key", "rubric_key", "raw", F.col("d").cast("timestamp").alias("answered_at"))
    got = joins.fresh_responses(asked, given, "2024-01-10", 10 * 86400)
    assert {r["id"]: r["raw"] for r in got.collect()} == {1: "new", 2: None}


def test_best_criteria_in_blocks(rows):
    docs = rows([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0])], "id LONG, embedding ARRAY<DOUBLE>")
    criteria = rows([(i, [float(i % 3), float(i % 5)]) for i in range(20)], "criterion_no LONG, criterion ARRAY<DOUBLE>")
    for block in (3, 256):
        got = {(r["id"], r["criterion_no"]): r["score"] for r in joins.best_criteria(docs, criteria, 2, block=block).collect()}
        assert got == {(1, 5): 10, (1, 10): 10, (2, 3): 10, (2, 4): 10, (3, 0): 1, (3, 1): 1}


def test_merged_audience_patterns_find_what_the_stated_ones_find():
    import random
    import re

    rng = random.Random(4)
    parts = sorted({w for x in p.AUDIENCE_PATTERNS for w in re.sub(r"\\b|\(s\)\?|\.\*", " ", x).split()})
    parts += ["leaders", "executives", "x", "\n", "retailer", "AI", "Leaders"]
    stated = [re.compile(x, re.I) for x in p.AUDIENCE_PATTERNS]
    merged = re.compile("|".join(f"(?:{x})" for x in p.AUDIENCE_MERGED), re.I)
    hits = 0
    for _ in range(20_000):
        text = rng.choice(["", " "]).join(rng.choices(parts, k=2)) + " " + " ".join(rng.choices(parts, k=rng.randrange(4)))
        want = any(x.search(text) for x in stated)
        assert bool(merged.search(text)) == want, text
        hits += want
    assert 1000 < hits < 19_000
