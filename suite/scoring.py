"""Keyword analysis over whole documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from accountlake import vocab
from accountlake.config import Profile
from accountlake.functions import scoring as S
from accountlake.functions import usage
from accountlake.functions.text import company_name, content_hash, contained, first_paragraph, normalise_text
from accountlake.operators.analysis import analyse
from accountlake.operators.pages import with_signals
from suite.pages import PATTERNS, rendered
from suite.registry import query, table
from suite.sqltext import SITE, TEXT, TITLE

# Tables drawn from the invented words of the data, so that every rule fires somewhere.
CATEGORIES = {
    "nord": ("der die", "und", "ist"), "west": ("eau", "les ", "tion"), "ost": ("the th", "hat", "er th"),
    "sued": ("los ", "que", "ción"), "kein": ("zzzz",),
}
B2B, B2C = ("the ", "eau", "und ", "thand"), ("que ", "ich", "tion", "elle")
BIG, SMALL = ("auf", "hat ", "aux ", "inen"), ("nicht", "ouan", "los", "ein ")
CART, SERVICES = ("thwas", "elleaux"), ("heit", "ión")
AREAS = tuple("eau aux tion elle the and that her ein ich ver keit los que ment das".split())
GOOD = tuple("the er of|eaux ré|und der|in the|que le|en el|die ein|er an the|zzz".split("|"))
POOR = ("pas une", "nicht", "that the", "de los")
PROFILE = Profile("t", "d", good_keywords=GOOD, poor_keywords=POOR)
BULLETS = ("the tion, of eau and ment", "und die ver: der keit heit", "los que; ment elle aux")
PROSE = Profile("t", "d", good_fit=BULLETS, poor_fit=("nicht der ein", "tion pas une elle"))

RAW = "raw AS (SELECT doc_id, text, lower(text) AS raw FROM documents)"
NORM = "trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s]+', ' ', 'g'), '\\s+', ' ', 'g'))"
CORPUS = f"corpus AS (SELECT doc_id, text, {NORM} AS corpus FROM documents)"


def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", F.lower("text").alias("raw"))


def corpora(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", normalise_text("text").alias("corpus"))


def hits(words, column="raw"):
    return "(" + " + ".join(f"contains({column}, '{w}')::INT" for w in words) + ")"


def found(words, column="corpus"):
    return "list_filter([" + ", ".join(f"CASE WHEN contains({column}, '{w}') THEN '{w}' END" for w in words) + "], lambda x: x IS NOT NULL)"


def occurrences(words):
    return "(" + " + ".join(f"((length(raw) - length(replace(raw, '{w}', ''))) // {len(w)})" for w in words) + ")"


CATEGORY_SQL = (
    "list_max([" + ", ".join(
        f"{{'score': {occurrences(ws)}, 'ord': {-i}, 'name': '{name}'}}" for i, (name, ws) in enumerate(CATEGORIES.items())
    ) + "])"
)


@query("category", f"WITH {RAW}, b AS (SELECT doc_id, {CATEGORY_SQL} AS best FROM raw) SELECT doc_id, CASE WHEN best.score >= 2 THEN best.name ELSE 'unknown' END AS category FROM b")
def category(spark, sf):
    return docs(spark, sf).select("doc_id", S.category("raw", CATEGORIES).alias("category"))


@query("marker_counts", f"WITH {RAW} SELECT doc_id, {hits(B2B)}::BIGINT AS business, {hits(B2C)}::BIGINT AS consumer, {hits(BIG)}::BIGINT AS enterprise, {hits(SMALL)}::BIGINT AS small FROM raw")
def marker_counts(spark, sf):
    count = lambda ws: S.count_contained(F.col("raw"), ws).cast("long")
    return docs(spark, sf).select(
        "doc_id", count(B2B).alias("business"), count(B2C).alias("consumer"), count(BIG).alias("enterprise"), count(SMALL).alias("small")
    )


@query("keyword_hits", f"WITH {CORPUS} SELECT doc_id, len(g)::BIGINT AS good, len(p)::BIGINT AS poor, array_to_string(g, '; ') AS good_terms, array_to_string(p, '; ') AS poor_terms FROM (SELECT doc_id, {found(GOOD)} AS g, {found(POOR)} AS p FROM corpus)")
def keyword_hits(spark, sf):
    good, poor, _ = S.good_and_poor("corpus", PROFILE)
    h = corpora(spark, sf).select("doc_id", good.alias("g"), poor.alias("p"))
    return h.select(
        "doc_id", F.size("g").cast("long").alias("good"), F.size("p").cast("long").alias("poor"),
        F.array_join("g", "; ").alias("good_terms"), F.array_join("p", "; ").alias("poor_terms"),
    )


def _score_sql(total):
    return f"greatest(least(50 + round_even(least(len(g) / {total}.0::DOUBLE * 1.6, 1.0) * 35.0, 0)::INT - least(len(p) * 15, 45), 100), 0)"


@query("fit_score", f"WITH {CORPUS} SELECT doc_id, {_score_sql(len(GOOD))}::BIGINT AS score FROM (SELECT doc_id, {found(GOOD)} AS g, {found(POOR)} AS p FROM corpus)")
def fit_score(spark, sf):
    good, poor, possible = S.good_and_poor("corpus", PROFILE)
    h = corpora(spark, sf).select("doc_id", good.alias("g"), poor.alias("p"))
    return h.select("doc_id", S.fit_score("g", "p", possible).cast("long").alias("score"))


def _bullet_sql(keys):
    return "CASE " + " ".join(f"WHEN contains(corpus, '{k}') THEN '{k}'" for k in keys) + " END"


# Word pairs of BULLETS and of PROSE's poor fits, written out.
GOOD_KEYS = [["eau ment"], ["und die", "die ver", "der keit", "keit heit"], ["los que", "ment elle", "elle aux"]]
POOR_KEYS = [["nicht der", "der ein"], ["tion pas", "pas une", "une elle"]]
_MATCH = "list_filter([" + ", ".join(_bullet_sql(k) for k in GOOD_KEYS) + "], lambda x: x IS NOT NULL)"
_MATCH_POOR = "list_filter([" + ", ".join(_bullet_sql(k) for k in POOR_KEYS) + "], lambda x: x IS NOT NULL)"


@query("match_bullets", f"WITH {CORPUS} SELECT doc_id, array_to_string(g, '; ') AS good_terms, array_to_string(p, '; ') AS poor_terms, {_score_sql(len(BULLETS))}::BIGINT AS score FROM (SELECT doc_id, {_MATCH} AS g, {_MATCH_POOR} AS p FROM corpus)")
def match_bullets(spark, sf):
    good, poor, possible = S.good_and_poor("corpus", PROSE)
    h = corpora(spark, sf).select("doc_id", good.alias("g"), poor.alias("p"))
    return h.select(
        "doc_id", F.array_join("g", "; ").alias("good_terms"), F.array_join("p", "; ").alias("poor_terms"),
        S.fit_score("g", "p", possible).cast("long").alias("score"),
    )


@query("bullet_bigrams", """
WITH w AS (SELECT doc_id, list_transform(string_split_regex(text, '[,;:]'), lambda c: list_filter(
    regexp_extract_all(regexp_replace(lower(c), '[^a-z0-9\\s]+', ' ', 'g'), '[a-z0-9][a-z0-9+-]*'), lambda x: x NOT IN ('the', 'und', 'le', 'de', 'of'))) AS clauses FROM documents),
p AS (SELECT doc_id, flatten(list_transform(clauses, lambda ws: list_transform(ws[2:], lambda x, i: ws[i] || ' ' || x))) AS pairs FROM w)
SELECT doc_id, len(pairs)::BIGINT AS n, substr(sha256(array_to_string(pairs, '|')), 1, 16) AS digest FROM p""")
def bullet_bigrams(spark, sf):
    """Every document read as one long bullet, with a short stop list."""
    pairs = table(spark, sf, "documents").select("doc_id", S.bullet_bigrams("text", ("the", "und", "le", "de", "of")).alias("p"))
    return pairs.select("doc_id", F.size("p").cast("long").alias("n"), content_hash(F.array_join("p", "|")).alias("digest"))


def _audience(b, c):
    return f"CASE WHEN {b} > {c} THEN 'B2B' WHEN {c} > {b} THEN 'B2C' ELSE 'Unclear' END"


def _segment(e, s):
    return f"CASE WHEN {e} >= 2 AND {e} > {s} THEN 'Enterprise' WHEN {s} >= 2 AND {s} > {e} THEN 'SMB' WHEN {e} > 0 AND {s} > 0 THEN 'Mixed' ELSE 'Unclear' END"


@query("sells_to", f"WITH {RAW} SELECT doc_id, {_audience(hits(B2B), hits(B2C))} AS sells_to FROM raw")
def sells_to(spark, sf):
    return docs(spark, sf).select("doc_id", S.sells_to("raw", B2B, B2C).alias("sells_to"))


@query("segment", f"WITH {RAW} SELECT doc_id, {_segment(hits(BIG), hits(SMALL))} AS segment FROM raw")
def segment(spark, sf):
    return docs(spark, sf).select("doc_id", S.segment("raw", BIG, SMALL).alias("segment"))


# Signals told from the text, under the standard names.
_SIG = {"has_pricing_page": "eaux", "has_login": "tion", "has_demo_cta": "hand", "has_free_trial": "und", "has_contact_sales": "que", "has_careers_page": "ich"}


def signalled(spark, sf):
    struct = F.struct(*[F.col("raw").contains(w).alias(n) for n, w in _SIG.items()])
    return docs(spark, sf).withColumn("signals", struct)


def _sig(name):
    return f"contains(raw, '{_SIG[name]}')"


@query("business_model", f"WITH {RAW} SELECT doc_id, CASE WHEN {_sig('has_pricing_page')} AND {_sig('has_login')} THEN 'SaaS' WHEN {hits(CART)} > 0 THEN 'Ecommerce' WHEN {hits(SERVICES)} > 0 THEN 'Services' ELSE 'Unclear' END AS business_model FROM raw")
def business_model(spark, sf):
    return signalled(spark, sf).select("doc_id", S.business_model("raw", "signals", CART, SERVICES).alias("business_model"))


@query("primary_cta", f"WITH {RAW} SELECT doc_id, CASE WHEN {_sig('has_demo_cta')} THEN 'Book a demo' WHEN {_sig('has_free_trial')} THEN 'Start a free trial' WHEN {_sig('has_contact_sales')} THEN 'Contact sales' ELSE 'None' END AS cta FROM raw")
def primary_cta(spark, sf):
    return signalled(spark, sf).select("doc_id", S.primary_cta("signals").alias("cta"))


@query("industries", f"WITH {RAW} SELECT doc_id, array_to_string({found(AREAS, 'raw')}[1:8], '; ') AS industries FROM raw")
def industries(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(S.industries("raw", AREAS, vocab.MAX_INDUSTRIES), "; ").alias("industries"))


NOTES = {r"(eaux|und) [a-d]": "First kind", r"the (he|in|on)": "Second kind", r"zzz+": "Never"}


@query("buying_signals", f"""WITH {RAW} SELECT doc_id, array_to_string(list_filter([
  CASE WHEN {_sig('has_careers_page')} THEN 'Careers page is live (hiring)' END,
  CASE WHEN regexp_matches(raw, '(eaux|und) [a-d]') THEN 'First kind' END,
  CASE WHEN regexp_matches(raw, 'the (he|in|on)') THEN 'Second kind' END], lambda x: x IS NOT NULL), '; ') AS signals FROM raw""")
def buying_signals(spark, sf):
    return signalled(spark, sf).select("doc_id", F.array_join(S.buying_signals("raw", "signals", NOTES, vocab.MAX_BUYING_SIGNALS), "; ").alias("signals"))


@query("disqualifiers", f"""WITH {CORPUS} SELECT doc_id, array_to_string(list_filter([
  CASE WHEN len(p) > 0 THEN 'Poor-fit ICP terms present: ' || array_to_string(p[1:4], ', ') END,
  CASE WHEN length(text) < 800 THEN 'Homepage is very thin; may be a placeholder or JS-only site' END], lambda x: x IS NOT NULL), '; ') AS notes
FROM (SELECT doc_id, text, {found(POOR + GOOD)} AS p FROM corpus)""")
def disqualifiers(spark, sf):
    h = corpora(spark, sf).select("doc_id", "text", contained(F.col("corpus"), POOR + GOOD).alias("p"))
    return h.select("doc_id", F.array_join(S.disqualifiers("p", "text", vocab.MAX_DISQUALIFIERS, vocab.MAX_POOR_TERMS), "; ").alias("notes"))


@query("normalise_text", f"SELECT doc_id, substr(sha256({NORM}), 1, 16) AS digest, length({NORM}) AS chars FROM documents")
def normalise_text_query(spark, sf):
    return corpora(spark, sf).select("doc_id", content_hash("corpus").alias("digest"), F.length("corpus").cast("long").alias("chars"))


_LABEL = "split_part(domain, '.', 1)"
COMPANY_SQL = f"""
parts AS (SELECT *, string_split_regex(title, '\\s*[|–—-]\\s*') AS parts FROM titled),
short AS (SELECT *, list_min(list_transform(parts, lambda p, i: {{'n': length(p), 'i': i, 'part': p}})).part AS best FROM parts),
named AS (SELECT *, CASE WHEN length(best) BETWEEN 2 AND 60 THEN trim(best) ELSE upper(left({_LABEL}, 1)) || substr({_LABEL}, 2) END AS company FROM short)"""


@query("company_name", f"WITH {SITE}, titled AS (SELECT page_id, domain, replace({TITLE}, '.', ' - ') AS title FROM site), {COMPANY_SQL} SELECT page_id, company FROM named")
def company_name_query(spark, sf):
    pages = rendered(spark, sf).withColumn("title", F.replace("title", F.lit("."), F.lit(" - ")))
    return pages.select("page_id", company_name("title", "domain").alias("company"))


PARAGRAPH_SQL = (
    "coalesce(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda b: trim(regexp_replace(b, '[#*_>\\[\\]()]', '', 'g'), ' ' || chr(10) || chr(9))), "
    "lambda b: length(b) BETWEEN 40 AND 300 AND NOT starts_with(lower(b), 'http'))[1], '')"
)


@query("first_paragraph", TEXT + f" SELECT page_id, {PARAGRAPH_SQL} AS paragraph FROM page_text")
def first_paragraph_query(spark, sf):
    return rendered(spark, sf).select("page_id", first_paragraph("markdown").alias("paragraph"))


SIGNALS = {
    **PATTERNS, "has_pricing_page": (r"/la\n", r"/the"), "has_login": (r"eau",), "has_demo_cta": (r"/un",), "has_free_trial": (r"/de",),
    "has_contact_sales": (r"/to",), "has_careers_page": (r"/in",),
}


def analysed(spark, sf):
    """The whole analyzer on pages, with every table replaced by one that fires on the data."""
    return analyse(
        with_signals(rendered(spark, sf), SIGNALS), PROFILE, categories=CATEGORIES, verticals=AREAS,
        markers={"b2b": B2B, "b2c": B2C, "enterprise": BIG, "smb": SMALL, "cart": CART, "services": SERVICES}, signal_notes=NOTES,
    )


ANALYSED_SQL = TEXT + f""",
titled AS (SELECT *, nullif({TITLE}, '') AS title, {PARAGRAPH_SQL} AS paragraph FROM page_text), {COMPANY_SQL},
prep AS (SELECT *, lower(coalesce(title, '') || chr(10) || chr(10) || text) AS raw FROM named),
norm AS (SELECT *, trim(regexp_replace(regexp_replace(raw, '[^a-z0-9\\s]+', ' ', 'g'), '\\s+', ' ', 'g')) AS corpus, {CATEGORY_SQL} AS best_category FROM prep),
scored AS (SELECT *, {found(GOOD)} AS g, {found(POOR)} AS p FROM norm)"""


@query("keyword_analysis", ANALYSED_SQL + f"""
SELECT page_id, company AS company_name, left(CASE WHEN paragraph <> '' THEN paragraph ELSE company || ' homepage.' END, 200) AS one_liner,
  CASE WHEN best_category.score >= 2 THEN best_category.name ELSE 'unknown' END AS category,
  {_audience(hits(B2B), hits(B2C))} AS sells_to, {_segment(hits(BIG), hits(SMALL))} AS segment,
  array_to_string({found(AREAS, 'raw')}[1:8], '; ') AS industries, {_score_sql(len(GOOD))}::BIGINT AS score,
  'Heuristic keyword match only -- no model was used. ' || len(g) || ' good-fit and ' || len(p) || ' poor-fit ICP terms found on the page.' AS rationale,
  CASE WHEN length(text) > 1500 THEN 0.4 ELSE 0.2 END::DOUBLE AS confidence,
  CASE WHEN paragraph <> '' THEN 'category: ' || left(paragraph, 200) ELSE '' END AS evidence,
  substr(sha256(text), 1, 16) AS content_hash, 'heuristic:v1' AS analyzer, url AS source_url
FROM scored""")
def keyword_analysis(spark, sf):
    a = F.col("analysis")
    quotes = F.array_join(F.transform(a["evidence"], lambda e: F.concat(e["claim"], F.lit(": "), e["quote"])), "; ")
    return analysed(spark, sf).select(
        "page_id", a["company_name"].alias("company_name"), a["one_liner"].alias("one_liner"), a["category"].alias("category"),
        a["sells_to"].alias("sells_to"), a["segment"].alias("segment"), F.array_join(a["industries_served"], "; ").alias("industries"),
        a["icp_fit_score"].cast("long").alias("score"), a["icp_fit_rationale"].alias("rationale"), a["confidence"].alias("confidence"),
        quotes.alias("evidence"), F.col("provenance.content_hash").alias("content_hash"),
        F.col("provenance.analyzer").alias("analyzer"), F.col("provenance.source_url").alias("source_url"),
    )


@query("score_bands", f"""WITH {CORPUS}, s AS (SELECT doc_id, {_score_sql(len(GOOD))}::BIGINT AS score FROM (SELECT doc_id, {found(GOOD)} AS g, {found(POOR)} AS p FROM corpus))
SELECT CASE WHEN score >= 70 THEN 'green' WHEN score >= 45 THEN 'yellow' ELSE 'red' END AS band, count(*) AS n FROM s GROUP BY 1""")
def score_bands(spark, sf):
    return fit_score(spark, sf).groupBy(usage.score_band("score").alias("band")).agg(F.count("*").alias("n"))
