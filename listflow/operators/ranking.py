"""Keyword and résumé ranking: scores as one projection, then a top-k."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from listflow.functions import classify as C, fixed_values as fv
from listflow.functions.dates import age_days, days_before
from listflow.functions.rules import first_match, has_any, term_array
from listflow.functions.text import WS, collapse_space, contains_text, strip, text_or_empty
from listflow.operators.matching import MAX_BROADCAST_BYTES, top_per_group
from listflow.operators.quality import star_rating
from listflow.operators.search import where_all


def _strings(values: list[str]) -> Column:
    return term_array(values)


def _lower_list(col: str) -> Column:
    empty = F.array().cast("array<string>")
    return F.transform(F.coalesce(F.col(col), empty), lambda t: F.lower(t))


def _add(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms, F.lit(0))


def _as_int(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


# ------------------------------------------------------------------ keywords
def keyword_scores(df: DataFrame, keywords: list[str], facets: dict[str, str | None], as_of) -> DataFrame:
    """Add keyword, recency, quality and facet scores, tier and matched keywords.

    A keyword in the title counts twice. All of a listing's text is searched.
    """
    words = [k.lower().strip() for k in keywords if k.strip()]
    df = df.withColumn("_title", F.lower(text_or_empty(F.col("title")))).withColumn(
        "_text",
        F.concat(
            F.col("_title"), F.lit(" "), F.lower(text_or_empty(F.col("description"))), F.lit(" "),
            F.lower(text_or_empty(F.col("company_name"))), F.lit(" "),
            F.array_join(_lower_list("tech_stack"), " "),
        ),
    )
    in_text = {w: F.contains(F.col("_text"), F.lit(w)) for w in words}
    in_title = {w: F.contains(F.col("_title"), F.lit(w)) for w in words}
    hits = _add([_as_int(in_text[w]) + _as_int(in_title[w]) for w in words])
    keyword_score = F.least(F.lit(50), hits * (50 // max(len(words), 1)))

    days = age_days(F.col("posted_date"), as_of)
    recency = first_match([(points, days <= step) for step, points in fv.RECENCY_STEPS], fv.RECENCY_OLDER)
    recency = F.when(F.col("posted_date").isNull(), 0).otherwise(recency)
    rating = star_rating(as_of)
    bonus = _add(
        [
            F.when(F.col(facet) == facets[facet], points).otherwise(0)
            for facet, points in fv.FACET_BONUS.items()
            if facets.get(facet)
        ]
    )
    # Whole tokens first; without any, the substring hits. A term with white
    # space inside is never a token.
    padded = F.concat(F.lit(" "), collapse_space(F.col("_text")), F.lit(" "))
    unique = list(dict.fromkeys(words))
    single = [w for w in unique if not any(ch.isspace() for ch in w)]
    df = df.withColumn("_padded", padded)
    tokens = F.array_compact(
        F.array(*[F.when(F.contains(F.col("_padded"), F.lit(f" {w} ")), F.lit(w)) for w in single])
    ).cast("array<string>")
    loose = F.array_compact(F.array(*[F.when(in_text[w], F.lit(w)) for w in unique])).cast("array<string>")
    return (
        df.withColumns(
            {
                "keyword_score": keyword_score.cast("int"),
                "recency_score": recency.cast("int"),
                "quality_rating": rating,
                "facet_score": bonus.cast("int"),
                "days_old": F.coalesce(days, F.lit(fv.NO_DATE_AGE)),
                "is_new": F.coalesce(days <= 3, F.lit(False)),
                "_tokens": tokens,
                "_loose": loose,
            }
        )
        .withColumn("quality_score", F.col("quality_rating.stars") * 3)
        .withColumn(
            "_total",
            F.col("keyword_score") + F.col("recency_score") + F.col("quality_score") + F.col("facet_score"),
        )
        .withColumn("match_score", F.least(F.lit(100), F.col("_total")))
        .withColumn("match_tier", C.tier(F.col("_total")))
        .withColumn(
            "matched_keywords",
            F.array_sort(F.when(F.size("_tokens") > 0, F.col("_tokens")).otherwise(F.col("_loose"))),
        )
        .drop("_title", "_text", "_padded", "_tokens", "_loose", "_total")
    )


def newest(df: DataFrame, limit: int | None) -> DataFrame:
    """Optional cut to the newest candidates; none by default."""
    return df if limit is None else df.orderBy(F.desc("posted_date"), "id").limit(limit)


def keyword_candidates(
    df: DataFrame, as_of, facets: dict[str, str | None], location: str | None = None,
    days: int = fv.KEYWORD_RANK_DAYS, newest_only: int | None = None,
) -> DataFrame:
    conditions = [F.col("is_active"), F.col("posted_date") >= days_before(as_of, days)]
    conditions += [F.col(f) == v for f, v in facets.items() if v]
    if location:
        conditions.append(
            contains_text(F.col("location_city"), location) | contains_text(F.col("location_country"), location)
        )
    return newest(where_all(df, conditions), newest_only)


def rank_by_keywords(
    df: DataFrame, keywords: list[str], as_of, facets: dict[str, str | None] | None = None,
    location: str | None = None, limit: int = 30, minimum: int = fv.MIN_MATCH_SCORE,
    newest_only: int | None = None,
) -> DataFrame:
    """Best listings for keywords: score, then new ones, then the younger."""
    facets = facets or {}
    candidates = keyword_candidates(df, as_of, facets, location, newest_only=newest_only)
    scored = keyword_scores(candidates, keywords, facets, as_of).where(F.col("match_score") >= minimum)
    return scored.orderBy(F.desc("match_score"), F.desc("is_new"), F.asc("days_old"), F.asc("id")).limit(limit)


# ------------------------------------------------------------------ résumés
#: Candidates that a block holds.
PEOPLE_BLOCK = 64


@dataclass(frozen=True)
class Candidate:
    """What a résumé says, as plain values for one projection over all listings."""

    skills: list[str]
    level: str
    domain: str
    words: list[str] = field(default_factory=list)
    past_title_words: list[str] = field(default_factory=list)


def candidate_features(profiles: DataFrame) -> DataFrame:
    """Skills, level, domain and words of each profile.

    Input columns: ``resume_text``, ``skills``, ``experience_level``,
    ``experience_years``, ``work_history`` (array of structs with ``title``).
    """
    empty = F.array().cast("array<string>")
    text = F.lower(text_or_empty(F.col("resume_text")))
    named = F.transform(F.coalesce(F.col("skills"), empty), lambda s: strip(F.lower(s)))
    skills = F.array_sort(F.array_union(named, C.text_skills(F.col("resume_text"))))
    titles = F.transform(F.coalesce(F.col("work_history"), F.array()), lambda w: F.lower(w["title"]))
    title_words = F.filter(F.split(F.array_join(titles, " "), f"{WS}+"), lambda w: F.length(w) > 3)
    return profiles.withColumn("_skills", skills).select(
        *profiles.columns,
        F.col("_skills").alias("candidate_skills"),
        C.candidate_level(F.col("experience_level"), F.col("resume_text"), F.col("experience_years")).alias("candidate_level"),
        C.skill_domain(F.col("_skills"), F.col("resume_text")).alias("candidate_domain"),
        F.array_distinct(F.split(strip(text), f"{WS}+")).alias("resume_words"),
        F.array_distinct(title_words).alias("past_title_words"),
    )


def candidate_of(profiles: DataFrame) -> Candidate:
    """Read the features of a single profile."""
    rows = candidate_features(profiles).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("expected exactly one profile")
    r = rows[0]
    return Candidate(
        list(r.candidate_skills), r.candidate_level, r.candidate_domain,
        list(r.resume_words), list(r.past_title_words),
    )


@dataclass
class _Person:
    """A candidate's features as columns: literals, or those of a joined table."""

    skills: Column
    level: Column
    domain: Column
    words: Column
    past_title_words: Column


def _literals(person: Candidate) -> _Person:
    return _Person(_strings(person.skills), F.lit(person.level), F.lit(person.domain), _strings(person.words), _strings(person.past_title_words))


_FEATURES = ("_title", "_desc", "_level", "_tech", "_words", "_domain", "_senior", "_long", "_non_tech")


def listing_features(df: DataFrame) -> DataFrame:
    """What scores need of a listing, whoever the candidate is."""
    df = df.withColumns(
        {
            "_title": F.lower(text_or_empty(F.col("title"))),
            "_desc": F.lower(text_or_empty(F.col("description"))),
            "_level": strip(F.lower(text_or_empty(F.col("experience_level")))),
            "_tech": F.array_distinct(_lower_list("tech_stack")),
        }
    )
    return df.withColumns(
        {
            "_words": F.array_distinct(F.filter(F.split(F.col("_title"), f"{WS}+"), lambda w: F.length(w) > 3)),
            "_domain": C.skill_domain(F.col("_tech"), F.concat(F.col("_title"), F.lit(" "), F.col("_desc"))),
            "_senior": has_any(F.col("_title"), fv.SENIOR_TITLE_TERMS),
            "_long": has_any(F.col("_desc"), fv.LONG_EXPERIENCE_TERMS),
            "_non_tech": has_any(F.col("_title"), fv.RANK_NON_TECH),
        }
    )


def _compatible(p: _Person) -> Column:
    """Hard filters: level, senior titles and long experience for juniors, non-tech titles."""
    other = F.col("_level").isin(["junior", "mid", "senior", ""])
    allowed = first_match([(F.col("_level").isin([*levels, ""]), p.level == name) for name, levels in fv.LEVELS_ALLOWED.items()], other)
    too_high = p.level.isin("intern", "junior") & (F.col("_senior") | F.col("_long"))
    return allowed & ~too_high & ~((F.size(p.skills) >= 3) & F.col("_non_tech"))


def compatible(df: DataFrame, person: Candidate) -> DataFrame:
    """Listings that pass one candidate's hard filters."""
    return listing_features(df).where(_compatible(_literals(person))).select(*df.columns)


def resume_scores(df: DataFrame, person: Candidate, matched_limit: int | None = None, missing_limit: int | None = None) -> DataFrame:
    """Skill, title, level, domain and description scores of one candidate.

    The limits cut the lists of matching and missing skills that are shown, not
    those that are scored.
    """
    return _scored(listing_features(df), _literals(person), matched_limit, missing_limit)


def _cut(values: Column, limit: int | None) -> Column:
    return values if limit is None else F.slice(values, 1, limit)


def _scored(df: DataFrame, p: _Person, matched_limit: int | None = None, missing_limit: int | None = None) -> DataFrame:
    df = df.withColumn("_in_desc", F.filter(p.skills, lambda s: F.contains(F.col("_desc"), s)))
    has_tech = F.size("_tech") > 0
    df = df.withColumns(
        {
            "_matched": F.when(has_tech, F.array_intersect(p.skills, F.col("_tech"))).otherwise(F.col("_in_desc")),
            "_missing": F.when(has_tech, F.array_except(F.col("_tech"), p.skills)).otherwise(F.array().cast("array<string>")),
        }
    )
    overlap = F.bround(F.size("_matched") / F.size("_tech") * 40, 0).cast("int")
    skill_score = F.when(has_tech, overlap).otherwise(F.least(F.lit(20), F.size("_matched") * 4))
    shared = F.size(F.array_intersect(F.col("_words"), p.past_title_words))
    known = F.size(F.array_intersect(F.col("_words"), p.words))
    title_score = F.least(F.lit(10), shared * 5) + F.least(F.lit(10), known * 2)
    pairs = [(points, (p.level == own) & (F.col("_level") == wanted)) for own, table in fv.LEVEL_BONUS.items() for wanted, points in table.items()]
    bonus = first_match(pairs, 0)
    df = df.withColumns(
        {
            "skill_score": skill_score,
            "title_score": title_score,
            "_bonus": bonus,
            "domain_score": F.when(F.col("_domain") == p.domain, 10)
            .when((F.col("_domain") == fv.SKILL_DOMAIN_DEFAULT) | (p.domain == fv.SKILL_DOMAIN_DEFAULT), 5)
            .otherwise(0),
            "description_score": F.least(F.lit(10), F.size("_in_desc") * 2),
        }
    )
    df = df.withColumn("level_score", F.greatest(F.lit(0), F.least(F.lit(20), F.col("_bonus") + 10)))
    total = _add([F.col(f"{n}_score") for n in ("skill", "title", "level", "domain", "description")])
    parts = F.array_compact(
        F.array(
            F.when(F.size("_matched") > 0, F.concat(F.size("_matched").cast("string"), F.lit(fv.REASON_SKILLS))),
            F.when(F.col("_bonus") >= 10, F.lit(fv.REASON_LEVEL)),
            F.when(F.col("domain_score") >= 8, F.concat(p.domain, F.lit(fv.REASON_DOMAIN))),
        )
    )
    reasoning = F.when(F.size(parts) > 0, F.array_join(parts, fv.REASON_JOINT)).otherwise(fv.REASON_NONE)
    df = df.withColumns(
        {
            "match_score": total,
            "match_reasoning": reasoning,
            "matching_skills": _cut(F.array_sort("_matched"), matched_limit),
            "missing_skills": _cut(F.array_sort("_missing"), missing_limit),
            "level_match": F.col("_level") == p.level,
        }
    ).withColumn("match_tier", C.tier(F.col("match_score")))
    return df.drop(*_FEATURES, "_in_desc", "_matched", "_missing", "_bonus")


def rank_for_resume(
    df: DataFrame, person: Candidate, as_of, days: int = fv.RESUME_RANK_DAYS, limit: int = 20,
    newest_only: int | None = None, matched_limit: int | None = None, missing_limit: int | None = None,
) -> DataFrame:
    """Best listings for one candidate: score, then the younger."""
    recent = df.where(F.col("is_active") & (F.col("posted_date") >= days_before(as_of, days)))
    scored = resume_scores(compatible(newest(recent, newest_only), person), person, matched_limit, missing_limit)
    return scored.orderBy(F.desc("match_score"), F.desc("posted_date"), F.asc("id")).limit(limit)


OTHER_LEVEL = "other"


def _level_class(level: Column) -> Column:
    """The rows of the table of allowed levels; a level that it does not name has the rule for all others."""
    return F.when(level.isin(list(fv.LEVELS_ALLOWED)), level).otherwise(F.lit(OTHER_LEVEL))


def _classes_allowed() -> Column:
    """The classes of candidates that a listing's level admits."""
    rules = [(name, [*levels, ""]) for name, levels in fv.LEVELS_ALLOWED.items()] + [(OTHER_LEVEL, ["junior", "mid", "senior", ""])]
    return F.array_compact(F.array(*[F.when(F.col("_level").isin(levels), F.lit(name)) for name, levels in rules]))


def rank_for_resumes(
    df: DataFrame, people: DataFrame, as_of, days: int = fv.RESUME_RANK_DAYS, limit: int = 20, block: int = PEOPLE_BLOCK,
    max_bytes: int = MAX_BROADCAST_BYTES, matched_limit: int | None = None, missing_limit: int | None = None,
) -> DataFrame:
    """Best listings for each candidate of a table, as ``rank_for_resume`` gives them, with ``candidate_id``.

    ``people`` has ``candidate_id, skills, level, domain, words,
    past_title_words``. Candidates stand in blocks of about ``block`` of one level
    class; a listing meets the blocks of the classes that its level admits. The
    blocks are broadcast, at most ``max_bytes`` of candidates in one pass over
    the listings, so the listings themselves cross no network: only the best of
    each candidate and task do. More candidates take more passes.
    """
    recent = df.where(F.col("is_active") & (F.col("posted_date") >= days_before(as_of, days)))
    fields = ("candidate_id", "skills", "level", "domain", "words", "past_title_words")
    person = F.struct(*fields)
    held, size = people.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(person))), F.lit(0))).first()
    passes = max(1, -(-size // max_bytes))
    blocks = max(1, -(-held // (passes * block)))
    met = listing_features(recent).withColumn("_class", F.explode(_classes_allowed()))
    p = _Person(*[F.col(f"_one.{n}") for n in fields[1:]])
    best = []
    for turn in range(passes):
        mine = people.where(F.pmod(F.xxhash64("candidate_id", F.lit(1)), F.lit(passes)) == turn)
        grouped = mine.groupBy(_level_class(F.col("level")).alias("_class"), F.pmod(F.xxhash64("candidate_id"), F.lit(blocks)).alias("_block"))
        grouped = grouped.agg(F.collect_list(person).alias("_people")).drop("_block")
        pairs = met.join(F.broadcast(grouped), "_class").withColumn("_one", F.explode("_people")).drop("_people", "_class")
        scored = _scored(pairs.where(_compatible(p)), p, matched_limit, missing_limit).withColumn("candidate_id", F.col("_one.candidate_id")).drop("_one")
        best.append(top_per_group(scored, ["candidate_id"], [F.desc("match_score"), F.desc("posted_date"), F.asc("id")], limit))
    return reduce(DataFrame.unionByName, best)
