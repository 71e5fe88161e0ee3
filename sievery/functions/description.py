"""Descriptions of postings: the section about the role, without boilerplate, in a few good sentences.

A description is read as paragraphs, and paragraphs open sections: of the role, of what surrounds it, or of a careers page.
Two folds over the paragraphs keep what belongs to the role. What is left is cleaned by an ordered table of rules, cut into
sentences, and the first of them that say something about the work are the description; diagnostics tell what was done.
"""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievery.functions import text
from sievery.functions.fields import MONTHS, any_of
from sievery.functions.values import let

# Headings of sections about the role, by name.
ROLE_SECTIONS = (
    ("purpose", r"(?i)purpose\s+of\s+(?:the\s+)?(?:role|position)"),
    ("position description", r"(?i)position\s+(?:specific\s+)?description"),
    ("position overview", r"(?i)position\s+overview"),
    ("position summary", r"(?i)position\s+summary"),
    ("job description summary", r"(?i)job\s+description\s+summary"),
    ("the position", r"(?i)the\s+position\b(?!\s+(?:overview|summary))"),
    ("about the position", r"(?i)about\s+the\s+(?:role|position)\b(?!\s+advanced)"),
    ("description", r"(?im)^description$"),
    ("summary", r"(?im)^summary$"),
    ("role summary", r"(?i)role\s+(?:summary|overview|description)"),
    ("about the role", r"(?i)about\s+(?:the\s+)?role"),
    ("what you will do", r"(?i)what\s+you(?:'|’)?(?:ll|\s+will)\s+do"),
    ("key responsibilities", r"(?i)key\s+responsibilities"),
    ("responsibilities", r"(?i)responsibilities"),
    ("duties", r"(?i)duties\s+and\s+(?:responsibilities|expectations)"),
    ("reports to", r"(?i)reports?\s+to"),
    ("compensation", r"(?i)compensation\b(?!\s+(?:and|&)\s+benefits)"),
    ("salary", r"(?i)salary\b(?!\s+(?:and|&)\s+benefits)"),
    ("requirements", r"(?i)requirements?\b(?!\s+(?:and|&)\s+qualifications)"),
    ("qualifications", r"(?i)qualifications?\b"),
    ("what we look for", r"(?i)what\s+we(?:'|’)?re\s+looking\s+for"),
    ("we are seeking", r"(?i)we\s+are\s+seeking\b"),
    ("the candidate", r"(?i)the\s+(?:ideal|right)\s+candidate"),
    ("job summary", r"(?i)job\s+summary"),
)
# Paragraphs that say nothing about the role.
OTHER_SECTIONS = (
    r"(?i)benefits?\b",
    r"(?i)perks?\b",
    r"(?i)DEI\b|diversity\s+(?:equity|inclusion)|equal\s+opportunity",
    r"(?i)how\s+we\s+support\s+our\s+(?:staff|team|employees)",
    r"(?i)office\s+(?:perks|amenities|lunch|snacks|dogs|pets)",
    r"(?i)fun\s+(?:facts|stuff|perks|benefits)",
    r"(?i)(?:view|see)\s+(?:all|more|our)\s+(?:jobs|openings|positions|roles)\b",
    r"(?i)powered\s+by\b",
    r"(?i)apply\s+(?:now|today|here)\b",
    r"(?i)join\s+(?:our\s+)?(?:talent\s+)?(?:community|network|team)\b",
    r"(?i)share\s+(?:this|the)\s+(?:job|posting|position)\b",
    r"(?i)follow\s+us\b",
    r"(?i)(?:copyright|©)\s+\d{4}",
    r"(?i)privacy\s+(?:policy|notice|statement)",
    r"(?i)terms\s+(?:of\s+)?(?:use|service|employment)",
    r"(?i)unsolicited\s+(?:resumes|cv)",
    r"(?i)recruitment\s+(?:agency|firm)",
    r"(?i)background\s+check",
    r"(?i)drug\s+(?:test|free|screen)",
    r"(?i)e-?verify\b",
    r"(?i)employment\s+is\s+contingent",
    r"(?i)(?:network\s+of\s+\d+|hundreds\s+of)\s+(?:local\s+)?(?:chapters|offices|employees)",
    r"(?i)our\s+(?:destinies|fates)\s+are\s+tied",
    r"(?i)we\s+(?:are\s+)?(?:an?\s+)?equal\s+opportunity\s+(?:employer|workplace)",
    r"(?i)work\s+(?:for|at|with)\s+us\b",
    r"(?i)why\s+(?:work|join)\s+(?:for|at|with)\s+us\b",
    r"(?i)life\s+at\b",
    r"(?i)our\s+(?:mission|values|culture|story)\b",
    r"(?i)about\s+(?:us|our\s+(?:company|organization))\b",
    r"(?i)careers?\s+(?:page|home|list|site)\b",
    r"(?i)current\s+openings?\b",
    r"(?i)as\s+we\s+think\s+about\s+a\s+growing\s+staff",
    r"(?i)competitive\s+(?:salaries|wages|pay)\b",
    r"(?i)professional\s+development\s+(?:and|&)\s+training",
)
# Headings that open a careers page's own sections, and those that end them.
CAREERS_PAGES = (
    r"(?i)how\s+we\s+support\s+our\s+(?:staff|team|employees)",
    r"(?i)current\s+openings",
    r"(?i)as\s+we\s+think\s+about\s+a\s+growing\s+staff",
    r"(?i)competitive\s+(?:salaries|pay|compensation)",
    r"(?i)professional\s+development\s+(?:and|&)\s+training",
    r"(?i)benefits?\s+(?:and|&)\s+(?:perks|compensation)",
    r"(?i)why\s+(?:work|join)\s+(?:for|at|with)\s+us",
    r"(?i)life\s+at\b(?!\s+(?:the\s+)?role)",
    r"(?i)our\s+(?:culture|values|mission|story)",
    r"(?i)join\s+our\s+team",
    r"(?i)careers?\s+(?:page|home|list)",
    r"(?i)view\s+(?:our\s+)?(?:open|current)\s+(?:positions|roles|jobs)",
)
ROLE_HEADINGS = (
    r"(?i)purpose\s+of\s+(?:the\s+)?(?:role|position)",
    r"(?i)position\s+(?:specific\s+)?description",
    r"(?i)position\s+overview",
    r"(?i)position\s+summary",
    r"(?i)job\s+description\s+summary",
    r"(?i)the\s+position\b(?!\s+(?:overview|summary))",
    r"(?i)about\s+the\s+(?:role|position)\b(?!\s+advanced)",
    r"(?im)^description$",
    r"(?im)^summary$",
    r"(?i)reports?\s+to",
    r"(?i)job\s+status",
    r"(?i)(?:about|overview\s+of)\s+(?:the\s+)?role",
    r"(?i)role\s+(?:overview|summary|description)",
    r"(?i)what\s+(?:you(?:'|’)ll|you\s+will)\s+do",
    r"(?i)key\s+responsibilities",
    r"(?i)responsibilities",
    r"(?i)duties\s+and\s+(?:responsibilities|expectations)",
    r"(?i)qualifications",
    r"(?i)requirements",
    r"(?i)what\s+(?:we(?:'|’)?re\s+)?looking\s+for",
)
# What goes from the text of a role, in this order, and what stands in its place.
NOISE = (
    (r"[>›»]+", " "),
    (r"\s*=\s*", " "),
    (r"(?i)&(?:amp|nbsp|quot|apos|#39|lt|gt);", " "),
    (r"(?i)https?://\S+", " "),
    (r"(?i)\bno\s*wrap\b|\bnowrap\b", " "),
    (r"(?i)\b(?:next|previous)\s*:\s*(?:next|previous)\s+post\s*:[^.]{0,200}", " "),
    (r"(?i)\bPrevious:\s*[^.]{0,200}\bNext:\s*[^.]{0,200}", " "),
    (r"(?i)\b(?:previous|next)\s*post\b[:\s-]*", " "),
    (r"(?i)\bpost navigation\b[^.]{0,200}", " "),
    (r"(?i)\bTitle Business(?: Platform Location Date)?\b", " "),
    (rf"(?i)\bheaders?\b(?:\s+(?:{MONTHS})\s+\d{{1,2}},\s+\d{{4}})?", " "),
    (r"(?i)\bsee (?:new|current) openings\b", " "),
    (r"(?i)\b(?:apply online|apply now|apply today|submit application|learn more|read more|view job|view opening|back to jobs)\b", " "),
    (r"(?i)\b(?:share to|share on)\s+(?:twitter|facebook|linkedin)\b", " "),
    (r"(?i)\b(?:share this job|email this job|copy link|tweet)\b", " "),
    (r"(?i)\b\d+\s+hours?\)\s*(?:On-site|Remote|Hybrid)\b", " "),
    (r"\s+[oO]\s+(?=[A-Z])", ". "),
    (r"(?i)\bRemote roles?\s*:", " "),
    (r"[>\"<]+", " "),
    (r"(?i)\b(?:job title|department|location|reports to|supervises)\s*:\s*[^.\n]*?(?=(?:job title|department|location|reports to|supervises|duration|context|scope|role overview|about us|what you(?:'|’)ll do)\s*:|[.\n]|$)", " "),
    (r"(?i)\b(?:about us|about the company|about the role|job summary|role overview|what you'll do|what you will do|responsibilities|requirements|qualifications|preferred qualifications|benefits|details|context|scope|what you bring)\s*:?", " "),
    (r"(?i)\b(?:job title|department|reports to|supervises|duration|location)\s*:", " "),
    (r"\.\s*\.", ". "),
)
# Sentences that any posting may have.
BOILERPLATE = (
    r"(?i)equal opportunity",
    r"(?i)all qualified applicants",
    r"(?i)reasonable accommodation",
    r"(?i)e-verify",
    r"(?i)background check",
    r"(?i)drug test",
    r"(?i)unsolicited resumes",
    r"(?i)privacy policy",
    r"(?i)terms of use",
    r"(?i)candidate data",
    r"(?i)employment is contingent",
    r"(?i)veteran status",
    r"(?i)gender identity",
    r"(?i)race, color, religion",
    r"(?i)without regard to",
    r"(?i)apply now",
    r"(?i)click here to apply",
    r"(?i)next post",
    r"(?i)previous post",
    r"(?i)search jobs",
    r"(?i)search results",
    r"(?i)job openings",
    r"(?i)applicant privacy",
    r"(?i)applicant login",
    r"(?i)join talent community",
    r"(?i)employment scams",
    r"(?i)sample employment test",
    r"(?i)our destinies are tied",
    r"(?i)network of \d+ local chapters",
    r"(?i)how we support our staff",
    r"(?i)how we support our team",
    r"(?i)current openings",
    r"(?i)as we think about a growing staff",
    r"(?i)competitive salaries and wages",
    r"(?i)professional development and training",
    r"(?i)browse (?:our )?(?:current )?(?:job )?openings",
    r"(?i)all qualified candidates are encouraged",
    r"(?i)we encourage candidates from",
    r"(?i)we are (?:an )?equal opportunity",
    r"(?i)we are committed to creating",
    r"(?i)we are dedicated to building",
    r"(?i)we offer a (?:competitive|comprehensive).+(?:salary|benefit|compensation|package)",
    r"(?i)(?:our|the) (?:team|organization|culture) (?:is|are) (?:committed|dedicated|passionate)",
    r"(?i)we believe (?:that )?(?:diversity|equity|inclusion|our people)",
    r"(?i)(?:apply|submit) (?:your|an) (?:application|resume)",
    r"(?i)join (?:our|the) (?:team|talent community)",
    r"(?i)for (?:more|additional) information (?:about|regarding)",
    r"(?i)\b(?:why\s+)?work\s+(?:for|at|with)\s+(?:us|our\s+company|our\s+organization)\b",
)
SAYS_SOMETHING = r"(?i)[a-z]{3,}\s+(?:is|are|will|can|should|must|plans|coordinates|executes|supports|manages|builds|seeks|works|develops|leads|drives|partners|optimizes)|^(?:Leads?|Delivers?|Executes?|Manages?|Develops?|Supports?|Builds?|Seeks?|Works?|Drives?|Plans|Coordinates?|Optimizes|Partners|Values?|Researches?)\b"
ABOUT_WORK = r"(?i)role|position|responsible|support|manage|lead|coordinate|develop|partner|build|work with|candidate|team|mission|focus|scope"
WEAK_START = r"(?i)^(?:this role|the role will|will oversee|we grow|remote eligible|hybrid eligible)\b|^(?:we strongly encourage candidates|apply now|back to jobs|see all openings|www[.])|^[*•%–—)-]"
LABELS = r"(?i)^(?:job title|department|reports to|location|duration|apply now|apply today|submit application|learn more|read more|view job|view opening)\b"
SHORTEST_SENTENCE, SHORTEST_SECTION, MOST = 35, 30, 5


def paragraphs(x: Column, breaks: str = r"\n{2,}") -> Column:
    return F.filter(F.transform(F.split(x, breaks), lambda p: F.trim(F.regexp_replace(p, r"^\s+|\s+$", ""))), lambda p: p != "")


def without_careers_pages(x: Column, opening: tuple[str, ...] = CAREERS_PAGES, ending: tuple[str, ...] = ROLE_HEADINGS) -> Column:
    """Paragraphs outside the sections of a careers page: from a heading that opens one, itself included, to one about the role."""

    def step(state: Column, p: Column) -> Column:
        opens = any_of(p, opening)
        inside = opens | (state["inside"] & ~any_of(p, ending))
        return F.struct(inside.alias("inside"), F.when(inside, state["kept"]).otherwise(F.concat(state["kept"], F.array(p))).alias("kept"))

    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("kept"))
    return F.array_join(F.aggregate(paragraphs(x), start, step)["kept"], "\n\n")


def literals(pattern: str) -> tuple[str, ...]:
    """Lower-case runs of letters, one of which stands in the lower case of whatever ``pattern`` finds; none where that isn't plain to see."""
    bare = re.sub(r"^\(\?[im]+\)", "", pattern)
    if one := re.match(r"\(\?:([A-Za-z|]+)\)(?![?*])", bare):
        return tuple(one[1].lower().split("|"))
    while (less := re.sub(r"\((?:[^()\\]|\\.)*\)[?*+]?", " ", bare)) != bare:
        bare = less
    if re.search(r"[\[\]{}()]", bare):
        return ()
    bare = re.sub(r".[?*]", " ", re.sub(r"\\.[?*+]?", " ", bare))
    runs = [max(re.findall("[a-z]+", part.lower()), key=len, default="") for part in bare.split("|")]
    return tuple(runs) if all(len(run) > 1 for run in runs) else ()


def _gated(x: Column, low: Column, pattern: str) -> Column:
    """Whether ``pattern`` is found in ``x``; only asked where its letters are in ``low``, the lower case of ``x``."""
    may = [F.contains(low, F.lit(run)) for run in literals(pattern)]
    return functools.reduce(operator.or_, may) & x.rlike(pattern) if may else x.rlike(pattern)


def role_section(found: Column, sections: tuple[tuple[str, str], ...] = ROLE_SECTIONS, others: tuple[str, ...] = OTHER_SECTIONS) -> Column:
    """A struct of ``text`` and ``heading`` from paragraphs: before the first section about the role those that may be about it, then all but others.

    The heading is the first line of the first such section, or the section's name where that line is longer than 80 characters.
    """

    def named(p: Column, low: Column) -> Column:
        return F.coalesce(*[F.when(_gated(p, low, pattern), label) for label, pattern in sections])

    def heading(q: Column) -> Column:
        line = F.trim(F.split(q["text"], "\n")[0])
        return F.when(F.length(line) <= 80, line).otherwise(q["name"])

    def read(m: Column, at: Column) -> Column:
        def stays(q: Column, i: Column) -> Column:
            fits = ((at > 0) & (i >= at)) | ((F.length(q["text"]) >= SHORTEST_SECTION) & q["text"].rlike("[A-Z]"))
            other = F.lit(False)
            for pattern in others:
                other = other | _gated(q["text"], q["low"], pattern)
            return q["name"].isNotNull() | (fits & ~other)

        kept = F.array_join(F.transform(F.filter(m, stays), lambda q: q["text"]), "\n\n")
        headings = F.filter(F.transform(F.filter(m, lambda q: q["name"].isNotNull()), heading), lambda h: h != "")
        return F.when(m.isNotNull(), F.struct(kept.alias("text"), F.coalesce(F.get(headings, F.lit(0)), F.lit("")).alias("heading")))

    # A paragraph is named once; where the first name stands, from 1, is known before paragraphs are kept.
    told = F.transform(found, lambda p: let(F.lower(p), lambda low: F.struct(p.alias("text"), low.alias("low"), named(p, low).alias("name"))))
    return let(told, lambda m: let(F.array_position(F.transform(m, lambda q: q["name"].isNotNull()), F.lit(True)), lambda at: read(m, at)))


def sentence_paragraphs(x: Column) -> Column:
    """Running text as paragraphs: a sentence each, where a capital letter follows its end."""
    return paragraphs(F.regexp_replace(x, r"([.!?]\s+)(?=[A-Z])", "$1\n\n"))


def comparable(x: Column) -> Column:
    """What of a sentence tells it from others: words, without articles and labels."""
    bare = F.regexp_replace(x, r"(?i)\b(?:the|a|an)\b|\b(?:job title|department|location|reports to|supervises|duration)\b", " ")
    return text.identity_token(bare)


def _filled(x: Column, title: Column) -> Column:
    """Templates that lost their title get it back: ``The will`` becomes ``The <title> will``."""
    name = F.regexp_replace(title, r"([\\$])", r"\\$1")
    filled = F.regexp_replace(x, F.lit(r"\bThe\s+(will|is|are)\b"), F.concat(F.lit("The "), name, F.lit(" $1")))
    filled = F.regexp_replace(filled, F.lit(r"\bThe\s*,"), F.concat(name, F.lit(",")))
    filled = F.regexp_replace(filled, F.lit(r"(?i)\bAs the\s*,"), F.concat(F.lit("As the "), name, F.lit(",")))
    return F.when(title == "", x).otherwise(filled)


def normalized(df: DataFrame, description: str, title: str, name: str = "normalized") -> DataFrame:
    """``df`` with ``name``, a struct of ``raw``, ``description`` and ``diagnostics``, from the columns ``description`` (HTML or text) and ``title``.

    raw is the visible text outside sections of a careers page. diagnostics has ``heading_used``, ``section_used`` (the role's section
    replaced the whole text), ``leading_fragment_removed``, ``auto_capitalized``, ``fallback_sentence_used`` and ``sentences``, how many were fit.
    Null and empty texts give an empty description. Each step is columns of its own, so that no text is cleaned twice.
    """
    given = df.columns
    step = df.withColumns({"_title": text.normalize_whitespace(F.coalesce(F.col(title), F.lit(""))), "_given": F.coalesce(F.col(description).cast("string"), F.lit(""))})
    step = step.withColumn("_raw", text.normalize_whitespace(text.strip_html(without_careers_pages(F.col("_given")))))
    step = step.withColumn("_role", role_section(sentence_paragraphs(F.col("_raw"))))
    uses = F.length("_role.text") >= SHORTEST_SECTION
    cleaned = F.when(uses, F.col("_role.text")).otherwise(F.col("_raw"))
    for pattern, instead in NOISE:
        cleaned = F.regexp_replace(cleaned, pattern, instead)
    cleaned = F.regexp_replace(text.normalize_whitespace(cleaned), r"(?i)\b([A-Za-z][A-Za-z&,'/-]{2,})\b(?:\s+\1\b)+", "$1")
    step = step.withColumn("_cleaned", cleaned).withColumn("_cleaned", text.normalize_whitespace(_filled(F.col("_cleaned"), F.col("_title"))))
    prefix = F.when(F.col("_title") == "", "This role").otherwise(F.concat(F.lit("The "), F.regexp_replace("_title", r"([\\$])", r"\\$1")))
    led = F.regexp_replace(F.col("_cleaned"), r"^[\s>*•%–—-]+|^(?:[A-Z][A-Z\s/&-]{2,20}:)\s*", "")
    led = F.regexp_replace(led, F.lit(r"(?i)^((?:remote|hybrid) eligible|on-site|onsite|remote|hybrid)\b[:\s-]*"), F.concat(prefix, F.lit(" is $1 ")))
    led = F.regexp_replace(led, F.lit(r"(?i)^(will|would|can)\s+"), F.concat(prefix, F.lit(" $1 ")))
    step = step.withColumn("_led", F.regexp_replace(text.normalize_whitespace(led), r"^[)\]}>,.;:!?/\\|%+-]+\s*", ""))
    said = F.transform(F.regexp_extract_all("_led", F.lit(r"[^.!?]+[.!?]+|[^.!?]+$"), F.lit(0)), text.normalize_whitespace)
    fit = F.filter(said, lambda s: (F.length(s) >= SHORTEST_SENTENCE) & ~any_of(s, BOILERPLATE) & ~s.rlike(LABELS) & s.rlike(SAYS_SOMETHING) & ~s.rlike(r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}$"))
    step = step.withColumn("_fit", F.filter(F.transform(fit, lambda s: F.struct(comparable(s).alias("key"), s.alias("said"))), lambda s: F.length(s["key"]) >= 20))
    # The first of sentences that compare equal, those about the work before others.
    first = F.filter(F.col("_fit"), lambda s, i: (F.array_position(F.transform("_fit", lambda t: t["key"]), s["key"]) == i + 1) & (s["key"] != text.identity_token(F.col("_title"))))
    step = step.withColumn("_fit", F.transform(first, lambda s: s["said"]))
    step = step.withColumn("_chosen", F.slice(F.array_distinct(F.concat(F.filter("_fit", lambda s: s.rlike(ABOUT_WORK)), "_fit")), 1, MOST))
    step = step.withColumn("_text", F.when(F.size("_chosen") > 0, F.array_join("_chosen", " ")).otherwise(F.col("_led")))
    strong = F.filter("_fit", lambda s: ~s.rlike(WEAK_START))
    fallback = F.when(((F.size("_chosen") == 0) | F.col("_text").rlike(WEAK_START)) & (F.size(strong) > 0), strong[0])
    step = step.withColumn("_fallback", fallback).withColumn("_text", F.coalesce("_fallback", "_text"))
    # The first letter as a capital, whatever stands before it.
    at = F.length(F.regexp_extract("_text", "^[^a-zA-Z]*", 0))
    capital = F.concat(F.substring("_text", F.lit(1), at), F.upper(F.substring("_text", at + 1, F.lit(1))), F.substring("_text", at + 2, F.length("_text")))
    step = step.withColumn("_final", F.when(F.col("_text").rlike("[A-Za-z]{3}"), capital).otherwise(""))
    diagnostics = F.struct(
        F.col("_role.heading").alias("heading_used"),
        uses.alias("section_used"),
        (F.col("_led") != F.col("_cleaned")).alias("leading_fragment_removed"),
        ((F.col("_final") != "") & (F.col("_final") != F.col("_text"))).alias("auto_capitalized"),
        F.col("_fallback").isNotNull().alias("fallback_sentence_used"),
        F.size("_fit").alias("sentences"),
    )
    return step.select(*given, F.struct(F.col("_raw").alias("raw"), F.col("_final").alias("description"), diagnostics.alias("diagnostics")).alias(name))
