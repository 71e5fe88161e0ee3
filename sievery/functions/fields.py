"""Column builders for the fields of a posting: title, organisation, place, kind of work and field of work."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievery.functions.taxonomy import first_match
from sievery.functions.text import normalize_whitespace, strip_html
from sievery.functions.values import let, reasons

# Words and patterns by which fields are told apart.
ROLES = (
    "accountant|administrator|advisor|advocate|analyst|architect|assistant|associate|attorney|buyer|campaigner|consultant|content strategist|coordinator|counsel|designer|developer|director|"
    "economist|editor|engineer|executive|fellow|intern|lead|manager|officer|operator|planner|president|press secretary|producer|product manager|program(?:me)?r?|project manager|recruiter|"
    "representative|research(?:er| assistant| associate)?|scientist|secretary|specialist|strategist|supervisor|technician|writer"
)
ROLE = rf"(?i)\b(?:{ROLES})\b"
SINGLE_WORD_ROLES = ("analyst", "associate", "coordinator", "designer", "developer", "director", "engineer", "intern", "manager", "officer", "planner", "producer", "recruiter", "researcher", "specialist", "strategist", "writer")
PLACE_TITLES = ("portugal", "canada", "spain", "france", "germany", "italy", "london", "berlin", "remote", "usa", "united states")
STATES = (
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut", "delaware", "florida", "georgia", "hawaii", "idaho", "illinois", "indiana", "iowa", "kansas", "kentucky",
    "louisiana", "maine", "maryland", "massachusetts", "michigan", "minnesota", "mississippi", "missouri", "montana", "nebraska", "nevada", "new hampshire", "new jersey", "new mexico", "new york",
    "north carolina", "north dakota", "ohio", "oklahoma", "oregon", "pennsylvania", "rhode island", "south carolina", "south dakota", "tennessee", "texas", "utah", "vermont", "virginia", "washington",
    "west virginia", "wisconsin", "wyoming",
)
COMPANY_NOISE = ("inc", "llc", "ltd", "corp", "co", "company", "group", "holdings", "partners", "capital", "energy", "renewables", "solar")
SECTORS = (
    ("Clean Energy", "clean energy|electrification|renewable"),
    ("Climate Tech", "climate tech|climate software|carbon software"),
    ("Policy/Advocacy", "policy|advocacy|campaign"),
    ("Conservation", "conservation|nature|oceans|biodiversity"),
    ("Sustainability", "sustainability"),
    ("Climate Communications", "communications|storytelling|brand"),
)
MONTHS = "Jan|January|Feb|February|Mar|March|Apr|April|May|Jun|June|Jul|July|Aug|August|Sep|Sept|September|Oct|October|Nov|November|Dec|December"
WORKPLACE = r"Remote|Hybrid|On[ -]?site"
SUFFIX_PLACES = (
    r"(?i)^(?:remote|hybrid|on[ -]?site|anywhere|global|worldwide|multiple locations)$",
    r"(?i)^[a-z][a-z.' -]+, *[a-z]{2,3}(?: +(?:remote|hybrid|on-site))?$",
    r"(?i)^[a-z][a-z.' -]+, *(?:united states|usa|canada|uk|united kingdom|germany|france|italy|spain|portugal|netherlands|ireland|australia)$",
    r"(?i)^(?:new york|london|berlin|paris|madrid|dublin|chicago|remote within [a-z ]+|us - multiple locations)$",
)
# Signs of headlines in titles.
HEADLINES = (
    r"[!?]",
    r"[A-Za-z]{3,}\.\s+[A-Z]",
    r"\.\.\.",
    r"(?i)\b(?:linkedins?|article|interview|career questions|share their stories|click here|read my interview|want a .* career)\b",
)
SENTENCE_VERBS = r"(?i)\b(?:can|will|would|should|could|starting|read|learn|work|build|share|pivoting|explains|announces|joined|interview|impact|stands on)\b"
NAVIGATION_TITLES = r"(?i)^(?:current openings|open positions|jobs?)$"
# Titles that name no role.
BAD_TITLES = (
    r"(?i)^(previous|next|home|search|faq)\b",
    r"(?i)\b(?:our impact|life at|about(?:\s+it)?|job explorer)\b",
    r"(?i)\b(?:the power of all voices|eeo policy statement|know your rights)\b",
    r"(?i)\b(?:privacy|cookie(?:s)?|policy statement|search jobs|careers?)\b",
    r"(?i)^want a .* career\??$",
)
BAD_PLACES = rf"(?i)\bTitle Business(?: Platform Location Date)?\b|\bPOINT *\(|\blocality\b|\bgeo(?:code)?\b|\b(?:{MONTHS})\b +[0-9]{{1,2}}, *[0-9]{{4}}"
UNPLACED = r"(?i)\b(?:remote|hybrid|work from home|distributed team|remote-first|anywhere|global|multiple locations|various locations|location listed on application|worldwide)\b"

#: What titles are freed of, in order.
TITLE_CUTS = (
    (r"[>›»]+", " "),
    (r"(?i)\b(?:href|class|aria-label|target|data-[\w-]+|rel|style|headers) *= *(?:\"[^\"]*\"|'[^']*'|[^ >]+)", " "),
    (r"(?i)https?://[^ ]+", " "),
    (r"(?i)\b(?:next|previous) *: *(?:next|previous) +post *:|\bpost navigation\b|\bno *wrap\b", " "),
    (r"(?i) +(?:(?:remote|hybrid|on-?site) +)?[—-] +(?:full[- ]?time|part[- ]?time|contract|temporary|internship)\b.*$", ""),
    (r"\{[^}]*\}|\[[^\]]*\]", " "),
    (r"^[/|>:. -]+|[/|>:. -]+$", ""),
)
PLACE_CUTS = (
    (r"(?i)\b(?:null|undefined|n/a|not specified|location listed on application)\b", " "),
    (r"(?i)\bPOINT *\([^)]*\)|\blocality\b", " "),
    (r"(?i)\b(?:county|continent|administrative area level [0-9]+)\b[^,;|]{0,80}", " "),
    (r"(?i)\b(?:Title|Business Platform|Location|Date)\b", " "),
    (r"(?i)^ *(?:hybrid|remote|on[ -]?site) *[,/-] *", ""),
    (rf"(?i)\b(?:{MONTHS}) +[0-9]{{1,2}}, +[0-9]{{4}}\b.*$", " "),
    (r" *\| *", " "),
    (r" *,(?: *,)+", ", "),
    (r"^[,;:|/>. -]+|[,;:|/<. -]+$", ""),
)
ORGANIZATION_CUTS = ((r"(?i)\b(?:posted by|share this|related posts?)\b.*$", " "), (r"^[| ]+|[| ]+$", ""))
SEPARATORS = (" | ", " - ", " — ", " – ", " @ ", ", ")


def cut(x: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The text after all replacements, in order; white space normalised, null as empty."""
    x = normalize_whitespace(F.coalesce(x, F.lit("")))
    for pattern, by in rules:
        x = F.regexp_replace(x, pattern, by)
    return normalize_whitespace(x)


def any_of(x: Column, patterns: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | x.rlike(p)
    return found


def word_number(x: Column) -> Column:
    return F.when(x == "", 0).otherwise(F.size(F.split(x, " ")))


def workplace_name(x: Column) -> Column:
    """Remote, Hybrid or On-site where the text is just that, else null."""
    low = F.regexp_replace(F.lower(F.trim(x)), "[ -]", "")
    return F.when(low == "remote", "Remote").when(low == "hybrid", "Hybrid").when(low == "onsite", "On-site")


def company_core(x: Column) -> Column:
    """What names a company: lower-case words of letters and digits without legal forms and the like."""
    tokens = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", " ")), " ")
    return F.array_join(F.filter(tokens, lambda t: ~t.isin(*COMPANY_NOISE)), " ")


def without_company(title: Column, organization: Column) -> Column:
    """The title without a last part that names the company, as in ``Analyst | Acme Inc``; the first separator that fits counts."""

    def body(t: Column, core: Column) -> Column:
        cases = []
        for s in SEPARATORS:
            parts = F.split(t, re.escape(s))
            last = company_core(F.element_at(parts, -1))
            names = (F.size(parts) > 1) & (core != "") & (last != "") & (F.contains(core, last) | F.contains(last, core))
            cases.append(F.when(names, F.trim(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), s))))
        return F.coalesce(*cases, t)

    return let(title, lambda t: let(company_core(organization), lambda core: body(t, core)))


def title_parts(title: Column) -> Column:
    """A struct of ``title``, ``workplace`` and ``place``: what stands behind the title, in brackets, after a dash or alone, is told apart."""
    bracket = rf"(?i) *\(({WORKPLACE})\) *$"
    dash = r"^(.*?) +[—–-] +([^—–-]+(?:-[^—–-]+)?)$"
    tail = rf"(?i)^(.+?) +({WORKPLACE})$"

    def after_bracket(x: Column) -> Column:
        return F.struct(F.regexp_replace(x, bracket, "").alias("x"), workplace_name(F.regexp_extract(x, bracket, 1)).alias("work"))

    def after_dash(s: Column) -> Column:
        def split(right: Column) -> Column:
            is_work, is_place = workplace_name(right).isNotNull(), any_of(right, SUFFIX_PLACES)
            return F.struct(
                F.when(is_work | is_place, F.trim(F.regexp_extract(s["x"], dash, 1))).otherwise(s["x"]).alias("x"),
                F.coalesce(s["work"], F.when(is_place | is_work, workplace_name(F.regexp_extract(right, rf"(?i)\b({WORKPLACE})\b", 1)))).alias("work"),
                F.when(is_place & ~is_work, normalize_whitespace(F.regexp_replace(right, rf"(?i)\b(?:{WORKPLACE})\b", " "))).otherwise("").alias("place"),
            )

        return let(F.trim(F.regexp_extract(s["x"], dash, 2)), split)

    def after_tail(s: Column) -> Column:
        at_end = F.regexp_extract(s["x"], tail, 1)
        return F.struct(
            F.when(at_end != "", at_end).otherwise(s["x"]).alias("title"),
            F.coalesce(s["work"], F.when(at_end != "", workplace_name(F.regexp_extract(s["x"], tail, 2))), F.lit("")).alias("workplace"),
            s["place"].alias("place"),
        )

    x = normalize_whitespace(F.coalesce(title, F.lit("")))
    return let(let(let(x, after_bracket), after_dash), after_tail)


#: A part between bars that directly repeats.
REPEATED_PART = r"(?i)(?:(?<=^)|(?<=\| ))([^|]+?)(?:\s*\|\s*\1(?=\s*(?:\||$)))+"


def clean_title(title: Column, organization: Column) -> Column:
    """A title freed of markup, addresses, navigation, kinds of contract, the company, workplace and place, and parts between bars said once."""
    x = cut(F.regexp_replace(strip_html(F.coalesce(title, F.lit(""))), r"[. ]+$", ""), TITLE_CUTS)
    return title_parts(F.regexp_replace(without_company(x, organization), REPEATED_PART, "$1"))["title"]


def clean_organization(x: Column) -> Column:
    return cut(strip_html(F.coalesce(x, F.lit(""))), ORGANIZATION_CUTS)


def clean_location(x: Column, workplace: Column, title: Column) -> Column:
    """A place freed of markup and placeholders. Nothing, or just the title again, is Remote, or Hybrid / Anywhere where the work is hybrid."""
    hybrid = F.coalesce(workplace == "Hybrid", F.lit(False))

    def named(place: Column) -> Column:
        again = (title != "") & (F.lower(place) == F.lower(title))
        vague = place.rlike("(?i)^(?:anywhere|location flexible)$") & hybrid
        return F.when((place == "") | again, F.when(hybrid, "Hybrid / Anywhere").otherwise("Remote")).when(place.rlike("(?i)^hybrid$") | vague, "Hybrid / Anywhere").when(place.rlike("(?i)^remote$"), "Remote").otherwise(place)

    return let(cut(strip_html(F.coalesce(x, F.lit(""))), PLACE_CUTS), named)


def physical_location(x: Column) -> Column:
    """Whether the text can be a place on a map."""
    x = normalize_whitespace(F.coalesce(x, F.lit("")))
    return (x != "") & ~x.rlike(r"(?i)^(?:united states|us|usa|nationwide)$") & ~x.rlike(UNPLACED) & ~x.rlike(BAD_PLACES) & ~x.rlike(r"(?i)\b(?:previous post|next post|related posts?)\b")


def valid_location(x: Column) -> Column:
    x = normalize_whitespace(F.coalesce(x, F.lit("")))
    return (x != "") & ~x.rlike(BAD_PLACES)


def workplace(explicit: Column, texts: Column, location: Column) -> Column:
    """What the field says, else what the texts say, else On-site where the location is a place, else empty. Pay or a place in the field counts for nothing."""
    loose = F.regexp_replace(F.lower(normalize_whitespace(F.coalesce(explicit, F.lit("")))), "[_-]+", " ")
    is_pay = loose.rlike(r"[$£€]|\b(?:usd|cad|eur|gbp)\b")
    said = F.when(is_pay, None).when(loose.rlike(r"\bhybrid\b"), "Hybrid").when(loose.rlike(r"\b(?:onsite|on site|in office|office based)\b"), "On-site").when(loose.rlike(r"\b(?:remote|work from home|wfh)\b"), "Remote")
    low = F.lower(F.coalesce(texts, F.lit("")))
    told = F.when(low.rlike(r"\bhybrid\b|[0-9]+ +days? +in +office|in-?office days?|partially remote"), "Hybrid").when(low.rlike(r"\b(?:fully remote|remote|work from home|distributed team)\b"), "Remote").when(low.rlike(r"\b(?:on[ -]?site|in[ -]?office|office[ -]?based)\b"), "On-site")
    return F.coalesce(said, told, F.when(physical_location(location), "On-site"), F.lit(""))


def employment_type(x: Column, otherwise: str = "Full-time") -> Column:
    """One of six kinds; nothing is the default, anything else stays as it is."""
    text = normalize_whitespace(F.coalesce(x, F.lit("")))
    loose = F.regexp_replace(text, "[_-]+", " ")
    rules = (("Contract", r"\bcontract(?:or)?\b"), ("Temporary", r"\btemp(?:orary)?\b"), ("Internship", r"\bintern(?:ship)?\b"), ("Fellowship", r"\bfellow(?:ship)?\b"), ("Part-time", r"\bpart time\b"), ("Full-time", r"\bfull time\b"))
    return F.when(text.rlike("^[—– -]*$"), otherwise).otherwise(F.coalesce(first_match(loose, rules), text))


def sector(x: Column) -> Column:
    """One of the known sectors, else the text with capital first letters."""
    text = normalize_whitespace(F.coalesce(x, F.lit("")))
    titled = F.array_join(F.transform(F.split(text, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")
    return F.coalesce(first_match(text, SECTORS), titled)


def only_first_name(title: Column) -> Column:
    return title.rlike("^[A-Z][a-z]{2,20}$") & ~F.lower(title).isin(*SINGLE_WORD_ROLES)


def only_organization(title: Column, organization: Column) -> Column:
    core = company_core(title)
    return (core != "") & (core == company_core(organization))


def only_location(title: Column, location: Column) -> Column:
    low, place = F.lower(title), F.lower(normalize_whitespace(F.coalesce(location, F.lit(""))))
    return low.isin(*PLACE_TITLES) | ((low != "") & (low == place))


def no_title(title: Column, organization: Column, location: Column) -> Column:
    """Whether this is clearly no title of a role: a name, a company, a place, navigation, or without any word for a role."""
    x = normalize_whitespace(F.coalesce(title, F.lit("")))
    return (x == "") | only_first_name(x) | only_organization(x, organization) | only_location(x, location) | F.lower(x).isin(*STATES) | any_of(x, BAD_TITLES) | ~x.rlike(ROLE)


def title_quality(title: Column) -> Column:
    """A struct of ``confidence`` (high, medium, low) and ``warnings``."""

    def judged(x: Column) -> Column:
        n = word_number(x)
        headline = any_of(x, HEADLINES) | ((n > 8) & (x.rlike("[“”\"']") | x.rlike(SENTENCE_VERBS)))
        joined = x.rlike(r"(?i)<div|href=|class=|aria-label=|https?://|Current Openings|Open Positions") | (F.regexp_count(x, F.lit(r"(?i)\b(?:Remote|Hybrid|On-?site)\b")) >= 2) | (n > 14)
        return reasons(
            ("missing_title", x == ""),
            ("headline_like_title", headline),
            ("concatenated_title", joined),
            ("workplace_suffix_in_title", x.rlike(r"\b(?:Remote|Hybrid|On-site|Onsite)$")),
            ("date_fragment_in_title", x.rlike(rf"(?i)\b(?:{MONTHS})\b")),
            ("long_title", n > 10),
            ("navigation_title", x.rlike(NAVIGATION_TITLES)),
            ("missing_role_signal", ~x.rlike(ROLE)),
        )

    # A missing word for a role is said only where nothing else is.
    def levelled(found: Column) -> Column:
        others = F.filter(found, lambda w: w != "missing_role_signal")
        sure = F.arrays_overlap(found, F.array(*map(F.lit, ("missing_title", "headline_like_title", "concatenated_title", "navigation_title"))))
        level = F.when(sure, "low").when(F.size(others) > 0, "medium").when(F.size(found) > 0, "low").otherwise("high")
        return F.struct(level.alias("confidence"), F.when(F.size(others) > 0, others).otherwise(found).alias("warnings"))

    return let(let(normalize_whitespace(F.coalesce(title, F.lit(""))), judged), levelled)
