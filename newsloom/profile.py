"""Settings that drive every stage: term lists, patterns and limits.

Stages never read a clock or a settings file; whatever they need arrives as a
``Profile`` or as an explicit argument, so a run can be repeated exactly.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# ---------------------------------------------------------------------------
# Fixed values. These lists and patterns decide the results, so they are stated
# as they are; order matters for companies and tools (first match wins).
# ---------------------------------------------------------------------------
COMPANIES = (
    "Amazon", "Google", "Microsoft", "OpenAI", "Walmart", "eBay", "Target", "Meta", "Apple", "Adobe",
    "Salesforce", "Nvidia", "Anthropic", "Perplexity", "Crocs",
)
TOOLS = (
    "ChatGPT", "Gemini", "Claude", "SageMaker", "Copilot", "DALL-E", "Bard", "Midjourney", "Stable Diffusion",
    "Firefly", "GPT-4", "Llama", "Bedrock", "Grok",
)
RETAIL_TERMS = (
    "ecommerce", "retail", "shopping", "marketplace", "consumer", "personalization", "recommendation",
    "supply chain", "inventory", "merchandising", "sales", "customer experience", "revenue",
)
DEPLOYMENT_TERMS = ("deployed", "implemented", "launched", "in production", "currently using", "rolled out")
MAJOR_PLATFORMS = ("openai", "microsoft", "google", "amazon", "meta")
METRIC_WORDS = ("revenue", "sales", "cost", "efficiency", "productivity")
ROI_PATTERN = r"\d+%|\$\d+|\d+\s*million|\d+\s*billion|increased|reduced|improved|saved"
PROMOTIONAL_PATTERN = r"partner|partnership|sponsor|press release|proud|excited|pleased to|delighted to"
IN_HOUSE_PATTERN = r"own|homegrown|proprietary|in-house|its own"
COMMERCE_PATTERN = r"retail|commerce|shopping|marketplace"
GENERIC_TOOL_PATTERN = r"generative ai|large language model|llm"
GENERIC_TOOL_NAME = "Generative AI"
TITLE_TERMS = (
    "ai", "artificial intelligence", "machine learning", "chatgpt", "generative ai", "large language model", "llm",
)
CONTENT_TERMS = TITLE_TERMS + (
    "neural network", "deep learning", "algorithm", "data science", "model", "gpt", "transformer",
)
DIRECT_TITLE_TERMS = ("ai", "artificial intelligence", "machine learning", "chatgpt", "generative")
TOPIC_PATTERNS = (
    r"\bai\b", r"\bai-[a-z]+\b", r"\b[a-z]+-ai\b", r"\bartificial intelligence\b", r"\bmachine learning\b",
    r"\bdeep learning\b", r"\bneural network\b", r"\bgenerative ai\b", r"\bchatgpt\b", r"\blarge language model\b",
    r"\bllm\b",
)
CONSENT_PHRASES = (
    "cookie policy", "privacy notice", "consent form", "accept cookies", "terms of use", "privacy policy",
)
NON_ARTICLE_URL_PATTERNS = (
    r"/privacy\b", r"/terms\b", r"/about\b", r"/contact\b",
    r"/(category|categories)/[^/]+/?$", r"/tag(s)?/[^/]+/?$", r"/topic(s)?/[^/]+/?$",
)
AUDIENCE_PATTERNS = (
    r"\bai leader(s)?\b",
    r"\bretail ai leader(s)?\b",
    r"\bai leader(s)? in retail\b",
    r"\bfor ai leader(s)?\b",
    r"\bai leadership\b",
    r"\bai executive(s)?\b",
    r"\bretail executive(s)?\b",
    r"\bindustry leader(s)?\b",
    r"\bthe retail leader(s)?\b",
    r"\bretail leader(s)?\b",
    r"\bthe target audience\b",
    r"\byour target reader\b",
    r"\bthe ai leader\b",
    r"\bleader(s)? in ai\b",
    r"\bleader(s)? concerned with\b",
    r"\binsights for.*leader(s)?\b",
    r"\brelevant.*leader(s)?\b",
    r"\bleader(s)? can leverage\b",
    r"\bthat.*leader(s)? can\b",
    r"\btools that.*leader(s)?\b",
    r"\benabling.*leader(s)?\b",
    r"\bhelping.*leader(s)?\b",
    r"\bassisting.*leader(s)?\b",
    r"\bfor.*leader(s)? to\b",
    r"\bleader(s)? to leverage\b",
    r"\bleader(s)? should\b",
    r"\bleader(s)? need\b",
    r"\bleader(s)? must\b",
)
BULLET_MARKS = ("*", "-", "•", "1.", "a)")
FAILED_TAKEAWAYS = (
    "Article content is too short or empty.",
    "Unable to process content.",
    "Content could not be processed properly.",
    "Error combining article summaries.",
    "Unable to analyze content at this time.",
)
FALLBACK_KEYWORDS = ("artificial intelligence news", "AI developments", "machine learning updates")
TEST_SOURCES = ("https://techcrunch.com/category/artificial-intelligence/",)
COORDINATOR_TEST_SOURCES = (
    "https://www.wired.com/tag/artificial-intelligence/",
    "https://www.retaildive.com/topic/technology/",
    "https://techcrunch.com/category/artificial-intelligence/",
)
CATEGORIES = (
    (1, "Content & Creative"),
    (2, "Business Intelligence (BI)"),
    (3, "Product Design & Manufacturing"),
    (4, "Supply Chain, Distribution & Logistics"),
    (5, "Enterprise Chat & Workplace AI"),
    (6, "Other Applications"),
    (7, "Competitor Updates"),
)
COMPETITORS = ("adidas", "nike", "deckers", "skechers", "oofos", "puma")
# TTLs in hours for remembered results
TTL_HOURS = {"source": 1, "metadata": 6, "text": 12, "chunk": 6, "summary": 24}
# ---------------------------------------------------------------------------

# Our own keyword table for the seven categories (the product asks a model).
CATEGORY_KEYWORDS = (
    (1, ("content generation", "creative", "visuals", "ads", "campaign", "seo", "personaliz")),
    (2, ("dashboard", "forecasting", "merchandising", "kpi", "insights", "replenishment")),
    (3, ("ideation", "concept", "product development", "design")),
    (4, ("supply chain", "inventory", "warehouse", "logistics", "shipping", "demand forecasting")),
    (5, ("enterprise", "custom gpt", "assistant", "knowledge", "productivity", "collaboration")),
)
OTHER_CATEGORY = 6
COMPETITOR_CATEGORY = 7

DEFAULT_RUBRIC = (
    "Write one paragraph of 3-4 sentences and 70-90 words. Name the companies and tools involved, quote figures only "
    "if the article states them, say what the news changes for retail, and use plain words without bullet points."
)


# Derived from AUDIENCE_PATTERNS: patterns that others contain are left out and those with a common part are one, so
# that a text is tried with ten patterns instead of 28. Both find the same texts (tests/test_rules.py).
AUDIENCE_MERGED = (
    r"\bai leaders?\b", r"\bai leadership\b", r"\b(ai|retail) executives?\b", r"\b(industry|retail) leaders?\b",
    r"\bthe target audience\b", r"\byour target reader\b",
    r"\bleaders? (in ai|concerned with|can leverage|to leverage|should|need|must)\b",
    r"\b(insights for|relevant|tools that|enabling|helping|assisting).*leaders?\b",
    r"\bthat.*leaders? can\b", r"\bfor.*leaders? to\b",
)


@dataclass(frozen=True)
class Profile:
    """Everything a scan can be configured with."""

    companies: tuple[str, ...] = COMPANIES
    tools: tuple[str, ...] = TOOLS
    retail_terms: tuple[str, ...] = RETAIL_TERMS
    deployment_terms: tuple[str, ...] = DEPLOYMENT_TERMS
    major_platforms: tuple[str, ...] = MAJOR_PLATFORMS
    metric_words: tuple[str, ...] = METRIC_WORDS
    roi_pattern: str = ROI_PATTERN
    promotional_pattern: str = PROMOTIONAL_PATTERN
    in_house_pattern: str = IN_HOUSE_PATTERN
    commerce_pattern: str = COMMERCE_PATTERN
    generic_tool_pattern: str = GENERIC_TOOL_PATTERN
    generic_tool_name: str = GENERIC_TOOL_NAME
    title_terms: tuple[str, ...] = TITLE_TERMS
    content_terms: tuple[str, ...] = CONTENT_TERMS
    direct_title_terms: tuple[str, ...] = DIRECT_TITLE_TERMS
    topic_patterns: tuple[str, ...] = TOPIC_PATTERNS
    consent_phrases: tuple[str, ...] = CONSENT_PHRASES
    category_keywords: tuple[tuple[int, tuple[str, ...]], ...] = CATEGORY_KEYWORDS
    competitors: tuple[str, ...] = COMPETITORS
    rubric: str = DEFAULT_RUBRIC
    lookback_days: int = 7
    max_report_articles: int = 10
    source_batch_size: int = 5
    min_confidence: int = 40

    def with_terms(self, **lists) -> "Profile":
        """A copy with whole lists replaced, as a settings override does."""
        return replace(self, **{k: tuple(v) if isinstance(v, list) else v for k, v in lists.items()})


# Lists for corpora of invented words, where the business lists hardly ever match.
CORPUS_PROFILE = Profile(
    companies=("Ther", "Thon", "Des"),
    tools=("tion", "ble", "que"),
    in_house_pattern="own",
    roi_pattern=r"\d+|stion|ander",
    metric_words=("that", "pour", "sich"),
    retail_terms=("with", "para", "nicht", "avec"),
    promotional_pattern="rewh|ction",
    deployment_terms=("from", "dans"),
    major_platforms=("thnd", "ciones"),
    commerce_pattern="this|para",
    generic_tool_pattern="stion|keit",
    title_terms=("ai", "ther", "eau", "ung", "cion"),
    content_terms=("ai", "ther", "eau", "ung", "cion", "tion", "the", "sch"),
    direct_title_terms=("ai", "ther", "eau"),
    topic_patterns=(r"\bthe\b", r"\bla-[a-z]+\b", r"\b[a-z]+-der\b", r"\bde\b", r"\bund\b", r"\bque los\b"),
    consent_phrases=("tion the", "que la", "ung der"),
    category_keywords=(
        (1, ("ther", "thon")),
        (2, ("tion", "ble")),
        (3, ("que", "les")),
        (4, ("sich", "und")),
        (5, ("para", "los")),
    ),
    competitors=("thnd",),
)
