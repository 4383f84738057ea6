"""Role, arrangement, recency and display rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearby_engine.functions.text import SPACE, strip
from nearby_engine.operators.ranking import once

RULE_VERSION = "technical-title-v1"

# Rule names and patterns for titles that are not technical, tried in this order.
NEGATIVE_RULES = {
    "non_technical_engineer": r"\b(sanitation\s+engineer|locomotive\s+engineer|train\s+engineer|stationary\s+engineer|building\s+engineer|custodial\s+engineer|civil\s+engineer|flight\s+engineer|sound\s+engineer|audio\s+engineer|marine\s+engineer|structural\s+engineer|mining\s+engineer)\b",
    "recruiting": r"\b(technical\s+recruiter|it\s+recruiter|engineering\s+recruiter|recruiter|recruiting|talent\s+acquisition|sourcer|headhunter)\b",
    "hr": r"\b(people\s+operations|people\s+partner|human\s+resources|\bhr\b|hr\s+business\s+partner|hr\s+manager|people\s+lead)\b",
    "sales": r"\b(account\s+executive|sales\s+representative|sales\s+rep|sales\s+associate|sales\s+director|sales\s+manager|\bsales\b|business\s+development|\bbdr\b|\bsdr\b|account\s+manager)\b",
    "marketing": r"\b(marketing|seo|sem|growth\s+marketer|content\s+writer|copywriter|social\s+media|communications|public\s+relations|\bpr\b)\b",
    "accounting": r"\b(accountant|accounting|controller|comptroller|payroll|accounts\s+payable|accounts\s+receivable|ap/ar|auditor|audit)\b",
    "finance": r"\b(financial\s+analyst|finance\s+manager|finance\s+director|treasury|investment\s+analyst)\b",
    "administrative": r"\b(office\s+manager|executive\s+assistant|admin\s+assistant|administrative\s+assistant|receptionist|facilities\s+manager)\b",
    "legal": r"\b(legal\s+counsel|general\s+counsel|paralegal|attorney|lawyer|compliance\s+officer)\b",
}

# Role classes and patterns for technical titles, tried in this order.
POSITIVE_RULES = {
    "engineering_leadership": r"\b(cto|chief\s+technology\s+officer|chief\s+architect|vp\s+of\s+engineering|vice\s+president\s+of\s+engineering|director\s+of\s+(?:software\s+)?engineering|director\s+of\s+technology|engineering\s+manager|software\s+engineering\s+manager|tech\s+lead|technical\s+lead|head\s+of\s+engineering|head\s+of\s+infrastructure|head\s+of\s+data)\b",
    "qa_automation": r"\b(sdet|software\s+development\s+engineer\s+in\s+test|qa\s+automation|automation\s+engineer|test\s+automation|quality\s+assurance\s+engineer|qa\s+engineer|quality\s+engineer|test\s+engineer|qa\s+analyst|quality\s+assurance\s+tester)\b",
    "security": r"\b(security\s+engineer|information\s+security|infosec|application\s+security|appsec|cybersecurity|cloud\s+security|soc\s+analyst|penetration\s+tester|security\s+analyst|cryptographer)\b",
    "infrastructure": r"\b(devops|site\s+reliability|sre|cloud\s+architect|cloud\s+infrastructure|infrastructure\s+engineer|platform\s+engineer|(?<!embedded\s)systems?\s+engineer|systems?\s+administrator|sysadmin|network\s+engineer|kubernetes\s+engineer|build\s+engineer|release\s+engineer)\b",
    "data": r"\b(data\s+engineer|data\s+scientist|machine\s+learning|ml\s+engineer|ai\s+engineer|ai\s+research|research\s+scientist|database\s+administrator|\bdba\b|analytics\s+engineer|business\s+intelligence|bi\s+developer|deep\s+learning|computer\s+vision|nlp\s+engineer)\b",
    "product_engineering": r"\b(product\s+engineer|solutions?\s+architect|technical\s+product\s+manager|\btpm\b|engineering\s+solutions?|solutions?\s+engineer)\b",
    "technical_support": r"\b(technical\s+support|customer\s+support\s+engineer|support\s+engineer|tier\s+[123]\s+support|application\s+support|it\s+support|escalation\s+engineer)\b",
    "software": r"\b(software\s+engineer|software\s+developer|backend|frontend|front\s+end|back\s+end|full\s*stack|mobile\s+engineer|mobile\s+developer|ios\s+developer|android\s+developer|embedded\s+(?:systems\s+)?engineer|firmware|web\s+developer|systems?\s+programmer|algorithm\s+engineer|application\s+developer|kernel\s+developer|programmer|coder)\b",
}

# Patterns that qualify or replace a rule.
TITLE_OVERRIDES_CATEGORY = r"\b(software|developer|architect|engineer|sdet)\b"
GENERAL_TITLE = r"\b(engineer|developer|architect)\b"
TECHNICAL_CATEGORY = r"\b(engineering|software|technology|tech|infrastructure|data|platform)\b"

# Arrangement words in structured fields and patterns in free text.
OFFICE_WORDS = ["in_office", "on_site", "onsite", "office"]
REMOTE_WORDS = ["remote", "telecommute"]
HYBRID_WORDS = ["hybrid", "flexible"]
HYBRID_TEXT = r"\b(hybrid|partially\s+remote|flexible\s+remote|\d+\s+days\s+(?:in\s+office|wfh))\b"
REMOTE_TEXT = r"\b(remote|work\s+from\s+home|\bwfh\b|telecommute|anywhere\s+in\s+(?:the\s+)?us|100%\s+remote|fully\s+remote)\b"
ONSITE_TEXT = r"\b(on-site|onsite|on\s+site|in-office|in\s+office|office-based|strictly\s+on-site|at\s+our\s+headquarters|relocation\s+required)\b"

# Recency window and the posting state behind each publication state.
RECENT_DAYS = 14
JOB_STATE = {"posted_recently": "open", "observed_recently": "open", "stale": "stale"}

# Client-side names of run states and arrangements.
CLIENT_STATUS = {"pending": "queued", "running": "in_progress", "partial": "completed"}
ARRANGEMENT_ALIASES = {"onsite": "in_office"}
ARRANGEMENT_LABELS = {"in_office": "In-Office", "hybrid": "Hybrid", "remote": "Remote"}

def _on_lower(pattern: str) -> str:
    """The pattern for text already in lower case: no case flag, Unicode blanks and digits."""
    return pattern.replace(r"\s", SPACE).replace(r"\d", r"\p{Nd}")


def _hit(text: Column, pattern: str) -> Column:
    """The matched text, null without a match."""
    regex = _on_lower(pattern)
    return F.when(text.rlike(regex), F.regexp_extract(text, regex, 0))


def role_title(title: Column) -> Column:
    """A title as the role rules read it."""
    return F.lower(F.coalesce(strip(title), F.lit("")))


def role_categories(categories: Column) -> Column:
    """Categories as the role rules read them."""
    given = F.coalesce(categories, F.array().cast("array<string>"))
    return F.transform(F.filter(given, lambda c: c.isNotNull() & (c != "")), lambda c: F.lower(strip(c)))


def role_reason(name: Column, cleaned: Column) -> Column:
    """The first rule that decides about a prepared title, as a reason string.

    ``coalesce`` stops at the first hit, so later patterns are not evaluated.
    """
    joined = F.array_join(cleaned, " ")
    together = F.concat(name, F.lit(" "), joined)
    category_counts = (F.size(cleaned) > 0) & ~name.rlike(_on_lower(TITLE_OVERRIDES_CATEGORY))

    def tagged(prefix: str, rule: str, hit: Column) -> Column:
        return F.concat(F.lit(f"{prefix}:{rule}:"), hit)

    steps: list[Column] = []
    for rule, pattern in NEGATIVE_RULES.items():
        steps.append(tagged("negative_rule", rule, _hit(name, pattern)))
        steps.append(F.when(category_counts, tagged("negative_rule_category", rule, _hit(joined, pattern))))
    steps += [tagged("title_match", rule, _hit(name, p)) for rule, p in POSITIVE_RULES.items()]
    steps += [tagged("combined_match", rule, _hit(together, p)) for rule, p in POSITIVE_RULES.items()]
    general = name.rlike(_on_lower(GENERAL_TITLE)) & F.exists(
        cleaned, lambda c: c.rlike(_on_lower(TECHNICAL_CATEGORY))
    )
    steps.append(F.when(general, F.lit("category_and_title_engineer")))
    return F.coalesce(*steps, F.lit("no_technical_rules_matched"))


def role_of_reason(reason: Column) -> Column:
    """Role struct from the deciding reason."""
    technical = reason.rlike("^(title_match|combined_match|category_and_title_engineer)")
    rule = F.when(reason == "category_and_title_engineer", F.lit("software")).otherwise(
        F.split_part(reason, F.lit(":"), F.lit(2))
    )
    return F.struct(
        technical.alias("is_technical"),
        F.when(technical, rule).otherwise(F.lit("")).alias("classification"),
        F.lit(RULE_VERSION).alias("rule_version"),
        F.array(reason).alias("reasons"),
    )


def with_role_reason(df: DataFrame, title: Column, categories: Column, into: str = "reason") -> DataFrame:
    """Add the deciding reason. Title and categories are prepared first, because every rule reads them."""
    prepared = once(df, {"_title": role_title(title), "_categories": role_categories(categories)})
    reasoned = once(prepared, {into: role_reason(F.col("_title"), F.col("_categories"))})
    return reasoned.drop("_title", "_categories")


def with_role(df: DataFrame, title: str, categories: str, into: str = "role") -> DataFrame:
    """Add the role struct for a title column and a category-array column."""
    reasoned = with_role_reason(df, F.col(title), F.col(categories), "_reason")
    return reasoned.withColumn(into, role_of_reason(F.col("_reason"))).drop("_reason")


def arrangement(
    text: Column | None = None,
    workplace_type: Column | None = None,
    location_type: Column | None = None,
    remote_flag: Column | None = None,
) -> Column:
    """Arrangement from structured fields first, free text second; conflicts give unknown."""
    nothing = F.lit(None).cast("string")
    kind = F.coalesce(workplace_type if workplace_type is not None else nothing, F.lit(""))
    kind = F.regexp_replace(F.lower(strip(kind)), r"[- ]", "_")
    place = F.upper(strip(F.coalesce(location_type if location_type is not None else nothing, F.lit(""))))
    flagged = F.coalesce(remote_flag if remote_flag is not None else F.lit(False), F.lit(False))
    body = F.lower(F.coalesce(text if text is not None else nothing, F.lit("")))

    office = kind.isin(OFFICE_WORDS)
    telecommute = (place == "TELECOMMUTE") | flagged
    hybrid_said, remote_said, onsite_said = (
        body.rlike(_on_lower(p)) for p in (HYBRID_TEXT, REMOTE_TEXT, ONSITE_TEXT)
    )
    return (
        F.when(office & telecommute, "unknown")
        .when(kind.isin(REMOTE_WORDS), "remote")
        .when(kind.isin(HYBRID_WORDS), "hybrid")
        .when(office, "in_office")
        .when(telecommute, "remote")
        .when(hybrid_said, "hybrid")
        .when(remote_said & onsite_said, "unknown")
        .when(remote_said, "remote")
        .when(onsite_said, "in_office")
        .otherwise("unknown")
    )


def page_arrangement(location_type: Column, title: Column) -> Column:
    """Arrangement of a posting found in page markup: remote, hybrid or unknown."""
    said = F.lower(F.concat_ws(" ", location_type, title))
    kind = F.lower(F.coalesce(location_type, F.lit("")))
    return (
        F.when(kind.contains("telecommute") | said.contains("remote"), "remote")
        .when(said.contains("hybrid"), "hybrid")
        .otherwise("unknown")
    )


def days_before(as_of: Column, days: int = RECENT_DAYS) -> Column:
    return as_of - F.make_dt_interval(F.lit(days))


def publication_state(
    posted_at: Column, first_seen_at: Column, as_of: Column, trusted: Column | None = None
) -> Column:
    """Recency of a posting; exactly 14 days is still recent."""
    known = posted_at.isNotNull() & (trusted if trusted is not None else F.lit(True))
    since = days_before(as_of)
    return (
        F.when(known & (posted_at >= since), "posted_recently")
        .when(known, "stale")
        .when(first_seen_at < since, "stale")
        .otherwise("observed_recently")
    )


def page_publication_state(posted_at: Column, as_of: Column) -> Column:
    """Recency of a posting found in page markup: whole days, so just under 15 days is recent."""
    age = F.floor((F.unix_micros(as_of) - F.unix_micros(posted_at)) / 86_400_000_000)
    return (
        F.when(posted_at.isNull(), "observed_recently")
        .when(age <= RECENT_DAYS, "posted_recently")
        .otherwise("stale")
    )


def lookup(value: Column, table: dict[str, str], default: Column) -> Column:
    """A small fixed mapping as a ``when`` chain."""
    chain = None
    for key, result in table.items():
        chain = F.when(value == key, result) if chain is None else chain.when(value == key, result)
    return chain.otherwise(default)


def job_state(publication: Column) -> Column:
    return lookup(publication, JOB_STATE, F.lit("unknown"))


def client_status(status: Column) -> Column:
    return lookup(status, CLIENT_STATUS, status)


def arrangement_alias(value: Column) -> Column:
    return lookup(value, ARRANGEMENT_ALIASES, value)


def arrangement_label(value: Column) -> Column:
    return lookup(value, ARRANGEMENT_LABELS, F.lit("Unknown"))


def shown_as_recent(publication: Column, posted_at: Column, as_of: Column) -> Column:
    within = posted_at.between(days_before(as_of), as_of)
    return (
        F.when(publication == "stale", False)
        .when(publication == "posted_recently", True)
        .otherwise(F.coalesce(within, F.lit(False)))
    )


def presence_label(presence: Column, confidence: Column) -> Column:
    percent = F.floor(confidence * 100.0 + 0.5)
    word = (
        F.when((presence == "confirmed_office") | (percent >= 80), "Confirmed")
        .when(presence == "job_location_only", "Hiring")
        .otherwise("Probable")
    )
    return F.concat(word, F.lit(" · "), percent.cast("string"), F.lit("%"))


def posted_age_label(posted_at: Column, as_of: Column, date_format: str = "M/d/yyyy") -> Column:
    days = F.floor((F.unix_micros(as_of) - F.unix_micros(posted_at)) / 86_400_000_000)
    return (
        F.when(posted_at.isNull(), "Recently")
        .when(days <= 0, "Today")
        .when(days == 1, "Yesterday")
        .when(days < RECENT_DAYS, F.concat(days.cast("string"), F.lit("d ago")))
        .otherwise(F.date_format(posted_at, date_format))
    )


def remote_scopes(codes: Column) -> Column:
    """Scope codes to distinct (scope_type, scope_code) structs, blanks dropped."""
    cleaned = F.filter(F.transform(codes, strip), lambda c: c != "")
    return F.array_distinct(
        F.transform(
            cleaned,
            lambda c: F.struct(
                F.when(c == "GLOBAL", "global")
                .when(c.rlike("^[A-Z]{2}$"), "country")
                .otherwise("region")
                .alias("scope_type"),
                c.alias("scope_code"),
            ),
        )
    )


def india_eligible(scope_type: Column, scope_code: Column, is_active: Column) -> Column:
    return is_active & ((scope_type == "global") | ((scope_type == "country") & (scope_code == "IN")))
