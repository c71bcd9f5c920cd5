"""Job boards: JSON lists and HTML pages to canonical listing rows.

Both kinds end in :func:`board_rows`, one projection of built-in functions. Only
the HTML layouts with nested cards need Python: a small parser that runs in
``mapInPandas`` over the page table and returns the raw card texts.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from listflow.functions import classify as C, fixed_values as fv
from listflow.functions.dates import as_timestamp, parse_date
from listflow.functions.extract import anchors, link_or_site, resolve_href, salary_range
from listflow.functions.rules import has_any, lookup
from listflow.functions.text import (
    first_filled, first_sentence, is_blank, key_hash, split_city, split_country, strip, text_or_empty,
)
from listflow.operators.matching import top_per_group


# ------------------------------------------------------------------ row builder
def board_rows(
    df: DataFrame, source: "str | Column", as_of, remote_hint: "str | Column" = "", keep: tuple[str, ...] = (),
    overrides: dict[str, object] | None = None,
) -> DataFrame:
    """Canonical rows from the raw texts of a board.

    Reads ``title, company, location, apply_url, description, salary_text,
    posted_text``; missing ones count as empty. ``overrides`` are the values a
    board forces on its rows; a null one leaves the row's own value.
    """
    have = set(df.columns)
    names = ("title", "company", "location", "apply_url", "description", "salary_text", "posted_text")
    hint = F.lit(remote_hint) if isinstance(remote_hint, str) else text_or_empty(remote_hint)
    forced = {n: v if isinstance(v, Column) else F.lit(v) for n, v in (overrides or {}).items()}
    staged = df.select(
        *keep,
        *[(text_or_empty(F.col(n)) if n in have else F.lit("")).alias(f"_{n}") for n in names],
        hint.alias("_hint"),
        (F.lit(source) if isinstance(source, str) else source).alias("_source"),
        *[v.alias(f"_forced_{n}") for n, v in forced.items()],
    )
    title, company, location, pay_text = (F.col(f"_{n}") for n in ("title", "company", "location", "salary_text"))
    # Values with several readers get a projection of their own.
    everything = F.concat_ws(" ", title, F.col("_description"), pay_text, F.col("_hint"))
    staged = staged.withColumns({"_all": everything, "_city": split_city(location), "_sentence": first_sentence(F.col("_description"))})
    staged = staged.withColumns(
        {
            "_low": F.lower("_all"),
            "_pay": salary_range(F.when(pay_text != "", pay_text).otherwise(F.col("_all"))),
        }
    )
    posted = F.coalesce(parse_date(F.col("_posted_text")), F.col("_posted_text").try_cast("timestamp"), as_timestamp(as_of))
    rows = {
        "title": strip(title),
        "company_name": strip(company),
        "location_city": F.col("_city"),
        "location_country": split_country(location),
        "apply_url": F.col("_apply_url"),
        "description": F.coalesce(F.nullif("_sentence", F.lit("")), F.concat(title, F.lit(" at "), company)),
        "salary_min": F.col("_pay.min"),
        "salary_max": F.col("_pay.max"),
        "salary_currency": F.lit("USD"),
        "salary_period": F.lit("yearly"),
        "experience_level": C.page_level(title),
        "job_type": F.when(F.contains(F.lower(title), F.lit("intern")), "internship").otherwise("full-time"),
        "remote_type": C.remote_from_text(F.when(F.col("_hint") != "", F.col("_hint")).otherwise(F.col("_low"))),
        "visa_sponsorship": has_any(F.col("_low"), fv.PAGE_VISA),
        "relocation_support": has_any(F.col("_low"), fv.PAGE_RELOCATION),
        "company_type": F.lit("startup"),
        "source_platforms": F.array("_source"),
        "is_active": F.lit(True),
        "is_stealth": F.lit(False),
        "dedup_hash": key_hash(company, title, F.col("_city"), F.lit("")),
        "posted_date": posted,
        "created_at": as_timestamp(as_of),
        "updated_at": as_timestamp(as_of),
        "last_seen_at": as_timestamp(as_of),
    }
    for name in forced:
        value = F.col(f"_forced_{name}")
        rows[name] = F.coalesce(value, rows[name]) if name in rows else value
    return staged.select(*keep, *[c.alias(n) for n, c in rows.items()])


# ------------------------------------------------------------------ JSON boards
@dataclass(frozen=True)
class JsonBoard:
    """Where a board's JSON keeps the fields, and what it forces."""

    source: str
    root: str  # path to the list, "[0]" behind a list on the way; "" = the payload is the list
    record: str
    title: str
    company: str
    location: tuple[str, str]  # field, default
    url: tuple[tuple[str, ...], str]  # fields in order, default
    description: str = ""
    posted: str = ""
    tags: str = ""
    remote: str = "remote"  # constant hint, or "flag" for the boolean field
    skip: int = 0
    overrides: dict = field(default_factory=dict)
    salary_currency: str = ""  # set when the board states a salary
    always_currency: bool = False
    need_title_company: bool = True


JSON_BOARDS = [
    JsonBoard(
        "YC-WATS", "results[0].hits",
        "title: string, company_name: string, location: string, url: string, description: string,"
        " remote: boolean, salary_min: double, salary_max: double, batch: string",
        "title", "company_name", ("location", "Remote"), (("url",), "https://www.workatastartup.com"),
        description="description", remote="flag_or_empty",
        overrides={"company_type": "vc_backed"}, salary_currency="USD", need_title_company=False,
    ),
    JsonBoard(
        "Arbeitnow", "data",
        "title: string, company_name: string, location: string, url: string, description: string,"
        " remote: boolean, tags: array<string>",
        "title", "company_name", ("location", ""), (("url",), "https://www.arbeitnow.com"),
        description="description", tags="tags", remote="flag",
    ),
    JsonBoard(
        "Remotive", "jobs",
        "title: string, company_name: string, candidate_required_location: string, url: string,"
        " description: string, tags: array<string>, publication_date: string",
        "title", "company_name", ("candidate_required_location", "Remote"), (("url",), "https://remotive.com"),
        description="description", posted="publication_date", tags="tags",
    ),
    JsonBoard(
        "Remotive-AI", "jobs",
        "title: string, company_name: string, candidate_required_location: string, url: string,"
        " description: string, tags: array<string>, publication_date: string",
        "title", "company_name", ("candidate_required_location", "Remote"), (("url",), "https://remotive.com"),
        description="description", posted="publication_date", tags="tags",
    ),
    JsonBoard(
        "Jobicy", "jobs",
        "jobTitle: string, companyName: string, jobGeo: string, url: string, jobExcerpt: string, pubDate: string",
        "jobTitle", "companyName", ("jobGeo", "Remote"), (("url",), "https://jobicy.com"),
        description="jobExcerpt", posted="pubDate",
    ),
    JsonBoard(
        "Himalayas", "jobs",
        "title: string, companyName: string, company_name: string, location: string, applicationLink: string,"
        " url: string, description: string, categories: array<string>",
        "title", "companyName,company_name", ("location", "Remote"),
        (("applicationLink", "url"), "https://himalayas.app"), description="description", tags="categories",
    ),
    JsonBoard(
        "RemoteOK", "",
        "position: string, company: string, location: string, url: string, apply_url: string,"
        " description: string, tags: array<string>, date: string",
        "position", "company", ("location", "Remote"), (("url", "apply_url"), "https://remoteok.com"),
        description="description", posted="date", tags="tags", skip=1,
    ),
    JsonBoard(
        "Adzuna-IN", "results",
        "title: string, company: struct<display_name: string>, location: struct<display_name: string>,"
        " redirect_url: string, adref: string, description: string, salary_min: double, salary_max: double,"
        " created: string",
        "title", "company.display_name", ("location.display_name", "India"), (("redirect_url", "adref"), ""),
        description="description", posted="created", remote="", salary_currency="INR",
    ),
    JsonBoard(
        "Adzuna-IN-Junior", "results",
        "title: string, company: struct<display_name: string>, location: struct<display_name: string>,"
        " redirect_url: string, adref: string, description: string, salary_min: double, salary_max: double,"
        " created: string",
        "title", "company.display_name", ("location.display_name", "India"), (("redirect_url", "adref"), ""),
        description="description", posted="created", remote="", salary_currency="INR",
        always_currency=True,
        overrides={"job_type": "full-time", "remote_type": "onsite", "experience_level": "junior"},
    ),
]


def _board_list(board: JsonBoard, payload: str) -> Column:
    """The board's list of records in its payload."""
    ddl = f"array<struct<{board.record}>>"
    steps = board.root.split(".") if board.root else []
    for step in reversed(steps):
        name = step.removesuffix("[0]")
        ddl = f"struct<{name}: {f'array<{ddl}>' if name != step else ddl}>"
    rows = F.from_json(payload, ddl)
    for step in steps:
        name = step.removesuffix("[0]")
        rows = F.get(rows[name], 0) if name != step else rows[name]
    return rows


FORCED = ("company_type", "job_type", "remote_type", "experience_level")


def _board_item(board: JsonBoard, record: Column, tag_limit: int | None) -> Column:
    """One record in the shape that all boards share."""
    names = {f.split(":")[0].strip() for f in board.record.split(",")}

    def value(path: str) -> Column:
        return reduce(lambda c, name: c[name], path.split("."), record)

    def text(*paths: str, default: str = "") -> Column:
        return F.coalesce(*[value(p) for p in paths if p], F.lit(default))

    place, default_place = board.location
    location = text(place, default=default_place)
    if board.source == "RemoteOK":  # an empty place counts as missing here
        location = first_filled(location, F.lit(default_place))
    hint = F.lit(board.remote)
    if board.remote.startswith("flag"):
        otherwise = "" if board.remote == "flag_or_empty" else "onsite"
        hint = F.when(F.coalesce(value("remote"), F.lit(False)), "remote").otherwise(otherwise)
    stated = {n: F.nullif(value(n), F.lit(0.0)) if n in names else F.lit(None).cast("double") for n in ("salary_min", "salary_max")}
    has_pay = F.lit(board.always_currency) | stated["salary_min"].isNotNull() | stated["salary_max"].isNotNull()
    currency = F.when(has_pay, board.salary_currency) if board.salary_currency else F.lit(None).cast("string")
    tag_list = value(board.tags) if board.tags else F.lit(None).cast("array<string>")
    backer = strip(F.concat(F.lit("YC "), text("batch"))) if "batch" in names else F.lit(None).cast("string")
    title, company = text(board.title), text(*board.company.split(","))
    fields = {
        "title": title,
        "company": company,
        "location": location,
        "apply_url": text(*board.url[0], default=board.url[1]),
        "description": text(board.description),
        "posted_text": text(board.posted),
        "_hint": hint,
        "_salary_min": stated["salary_min"],
        "_salary_max": stated["salary_max"],
        "_currency": currency,
        "_tags": F.when(F.size(tag_list) > 0, F.slice(tag_list, 1, tag_limit) if tag_limit is not None else tag_list),
        "_backer": backer,
        **{f"_{n}": F.lit(board.overrides.get(n)).cast("string") for n in FORCED},
        "_usable": (title != "") & (company != "") | F.lit(not board.need_title_company),
    }
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def json_board_items(
    pages: DataFrame, payload: str, source: str = "source", keep: tuple[str, ...] = (), boards: list[JsonBoard] = JSON_BOARDS,
    limit: int | None = None, tag_limit: int | None = None,
) -> DataFrame:
    """Raw items of landed payload texts, each of the board that ``source`` names, in one pass.

    All items and tags unless ``limit`` or ``tag_limit`` keep the first ones.
    """

    def of(board: JsonBoard) -> Column:
        found = _board_list(board, payload)
        rows = F.slice(found, board.skip + 1, F.lit(limit) if limit is not None else F.greatest(F.size(found), F.lit(0)))
        return F.when(F.col(source) == board.source, F.transform(rows, lambda r: _board_item(board, r, tag_limit)))

    lists = F.coalesce(*[of(board) for board in boards])
    items = pages.select(*keep, F.col(source).alias("source"), F.posexplode(lists).alias("pos", "_item"))
    return items.select(*keep, "source", "pos", "_item.*").where("_usable").drop("_usable")


def json_board_rows(items: DataFrame, as_of, keep: tuple[str, ...] = ()) -> DataFrame:
    """Canonical rows from the items of any boards, in one projection."""
    overrides = {
        **{n: F.col(f"_{n}") for n in FORCED},
        "salary_min": F.col("_salary_min"), "salary_max": F.col("_salary_max"), "salary_currency": F.col("_currency"),
        "tech_stack": F.col("_tags"), "vc_backer": F.col("_backer"),
    }
    return board_rows(items, F.col("source"), as_of, F.col("_hint"), (*keep, "source", "pos"), overrides)


# ------------------------------------------------------------------ HTML boards
@dataclass(frozen=True)
class Pick:
    """One element test: tag, class word, part of the class, part of the link, place in the row, ancestors."""

    tag: str = ""
    cls: str = ""
    part: str = ""
    href: str | None = None
    nth: int = 0
    attr: str = ""
    id: str = ""
    within: tuple["Pick", ...] = ()  # ancestors, the outermost first

    def fits(self, node: "_Node") -> bool:
        return self.fits_kind(node.tag, node.attrs.get("class") or "") and self.fits_rest(node)

    def fits_kind(self, tag: str, classes: str) -> bool:
        return (not self.tag or tag == self.tag) and (not self.cls or self.cls in classes.split()) and (not self.part or self.part in classes)

    def asks_more(self) -> bool:
        """Whether tag and classes alone do not tell."""
        return bool(self.href is not None or self.attr or self.nth or self.id or self.within)

    def fits_rest(self, node: "_Node") -> bool:
        a = node.attrs
        return (
            (self.href is None or ("href" in a and self.href in (a["href"] or "")))
            and (not self.attr or self.attr in a)
            and (not self.nth or node.place == self.nth)
            and (not self.id or a.get("id") == self.id)
            and (not self.within or self._lies_within(node))
        )

    def _lies_within(self, node: "_Node") -> bool:
        wanted = list(self.within)
        while wanted and (node := node.parent) is not None:
            if wanted[-1].fits(node):
                wanted.pop()
        return not wanted


def tags(*names: str) -> tuple[Pick, ...]:
    return tuple(Pick(tag=n) for n in names)


def parts(*names: str) -> tuple[Pick, ...]:
    return tuple(Pick(part=n) for n in names)


def classes(*names: str) -> tuple[Pick, ...]:
    return tuple(Pick(cls=n) for n in names)


@dataclass(frozen=True)
class HtmlBoard:
    """How a board's pages mark their cards, and what it forces."""

    source: str
    origin: str
    cards: tuple[Pick, ...]
    title: tuple[Pick, ...]
    company: tuple[Pick, ...] = ()
    location: tuple[Pick, ...] = ()
    salary: tuple[Pick, ...] = ()
    fallback: tuple[Pick, ...] = ()  # cards when the first list finds none
    unique_links: bool = True  # one row per link; cards without a link are skipped
    link_title: bool = True  # the link's text stands in for a missing title
    min_title: int = 4
    default_company: str = ""
    default_location: str = "India"
    default_url: str = ""
    need_company: bool = False
    absolute_only: str = ""  # used instead of any link that is not absolute
    join_any: bool = False  # every link that is not absolute gets the origin
    remote_hint: str = ""
    overrides: dict = field(default_factory=dict)


_HEADS = tags("h2", "h3", "h4")
HTML_BOARDS = [
    HtmlBoard(
        "YC-Jobs", "https://www.ycombinator.com", (Pick(tag="a", href="/companies/"),), tags("span", "div"),
         min_title=3, default_company="YC Company", default_location="Remote",
    ),
    HtmlBoard(
        "Simplify", "https://simplify.jobs", (*parts("job", "card", "listing"), Pick(tag="a", href="/p/")),
        (*tags("h2", "h3"), *parts("title")), parts("company", "org"), unique_links=False, link_title=False,
        default_company="YC Startup", default_location="Remote, USA",
        default_url="https://simplify.jobs/l/YC-Internships",
    ),
    HtmlBoard(
        "ArcDev", "https://arc.dev", (*parts("job"), *tags("article"), *parts("card", "listing")),
        (*_HEADS, *parts("title")), parts("company", "org", "employer"), parts("location", "loc"),
        parts("salary", "compensation", "pay"), unique_links=False, link_title=False,
        default_company="Arc.dev Company", default_location="Remote",
        default_url="https://arc.dev/remote-jobs/data-science", remote_hint="remote",
    ),
    *[
        HtmlBoard(
            tag, "https://web3.career",
            (Pick(tag="tr", part="job"), Pick(tag="div", part="job"), Pick(tag="a", href="/")),
            (*_HEADS, Pick(tag="td", nth=1), *parts("title")),
            (*parts("company"), Pick(tag="td", nth=2), *parts("org")), parts("location", "loc"),
            parts("salary", "compensation"), unique_links=False, link_title=False, need_company=True,
            default_location="Remote", default_url=f"https://web3.career/{path}", remote_hint="remote",
        )
        for tag, path in [
            ("Web3-DS", "data-science+remote-jobs"), ("Web3-Remote", "remote-jobs"),
            ("Web3-OKX", "web3-companies/okx+remote"),
        ]
    ],
    HtmlBoard(
        "MigrateMate", "https://migratemate.co", (*parts("job"), *tags("article"), *parts("card", "listing")),
        (*_HEADS, *parts("title")), parts("company", "org", "employer"), parts("location", "loc"),
        unique_links=False, link_title=False, default_company="Visa Sponsor Company",
        default_location="California, USA", join_any=True, overrides={"visa_sponsorship": True},
    ),
    HtmlBoard(
        "HasJob", "https://hasjob.co",
        (*[Pick(cls="listjob", within=(outer,)) for outer in (*classes("sticky-outer-wrapper", "stickycontainer"), Pick(id="main"), *classes("col-auto"))], Pick(tag="a", cls="listheader"), Pick(tag="div", attr="data-headline")),
        (*classes("headline"), *tags("h2", "h3")), classes("companyname", "company", "org"), classes("location"),
        fallback=(Pick(tag="a", href="/view/"),), default_company="Indian Company",
    ),
    HtmlBoard(
        "AI-Jobs", "https://ai-jobs.net",
        (*tags("article"), *classes("job-listing"), Pick(tag="tr", attr="class"), Pick(tag="div", cls="job-card"),
         Pick(tag="a", href="/job/")),
        (*_HEADS, *classes("title"), Pick(tag="td", nth=1)), (*classes("company", "org"), Pick(tag="td", nth=2)),
        (*classes("location", "loc"), Pick(tag="td", nth=3)), default_company="AI Company",
        default_location="Remote", overrides={"tech_stack": ["AI", "Machine Learning"]},
    ),
    HtmlBoard(
        "Karkidi", "https://karkidi.com",
        (Pick(tag="div", cls="ads-details"), Pick(tag="div", cls="job-listing"), *tags("article"),
         *classes("card"), Pick(tag="a", href="/job/")),
        (*_HEADS, *classes("title", "job-title")), classes("company", "org", "company-name"),
        classes("location", "loc", "job-location"), default_company="Indian AI Company",
        overrides={"tech_stack": ["AI", "Machine Learning", "Data Science"]},
    ),
    HtmlBoard(
        "Instahyre", "https://www.instahyre.com",
        (Pick(tag="div", cls="job-card"), Pick(tag="div", cls="listing"), *tags("article"),
         *classes("opportunity"), Pick(tag="a", href="/job/")),
        (*_HEADS, *classes("title", "job-title", "designation")), classes("company", "org", "company-name"),
        classes("location", "loc", "city"),
        fallback=(Pick(tag="a", href="/job/"), Pick(tag="div", part="job"), Pick(tag="div", part="listing")),
         default_company="Indian Startup",
    ),
    HtmlBoard(
        "Internshala", "https://internshala.com",
        (Pick(tag="div", cls="individual_internship"), Pick(tag="div", cls="internship_meta"), Pick(tag="div", part="job"),
         Pick(tag="a", href="/fresher-job/"),
         Pick(tag="div", part="internship", within=(Pick(tag="div", cls="container-fluid"), Pick(cls="internship_list_container")))),
        (*tags("h3", "h4"), *classes("job-internship-name", "profile"), *parts("title")),
        (*classes("company_name", "company-name"), *parts("company")),
        (*classes("location_link"), *parts("location"), *classes("loc")),
        fallback=(Pick(tag="a", href="/job/"), Pick(tag="a", href="/fresher")),
        default_company="Indian Startup",
        overrides={"experience_level": "junior", "job_type": "full-time", "remote_type": "onsite"},
    ),
    HtmlBoard(
        "Freshersworld", "https://www.freshersworld.com",
        (Pick(tag="div", part="job"), Pick(tag="a", href="/job/"), Pick(cls="job-details", within=(Pick(tag="div", cls="latest-jobs-block"),))),
        (*_HEADS, *classes("job-title"), *parts("title"), Pick(tag="span", cls="wrap-title")),
        (*classes("company-name"), *parts("company"), *classes("org")),
        (*classes("location"), *parts("loc"), *classes("city")),
        fallback=(Pick(tag="a", href="freshersworld.com/jobs"),), default_company="Indian Company",
        join_any=True,
        overrides={"experience_level": "junior", "job_type": "full-time", "remote_type": "onsite"},
    ),
    HtmlBoard(
        "CutShort", "https://cutshort.io",
        (Pick(tag="div", part="job"), Pick(tag="a", href="/job/"), Pick(tag="div", cls="listing"), *tags("article")),
        (*_HEADS, *parts("title", "designation")), parts("company", "org"), parts("location", "loc"),
        fallback=(Pick(tag="a", href="cutshort.io/j"),), default_company="Indian Startup",
    ),
    HtmlBoard(
        "Wellfound-IN", "https://wellfound.com",
        (Pick(tag="div", part="job"), Pick(tag="a", href="/jobs/"), Pick(tag="div", cls="styles_result"),
         Pick(tag="div", part="listing")),
        (*_HEADS, *parts("title")), parts("company", "org"), parts("location"),
        fallback=(Pick(tag="a", href="/company/"),), default_company="India Startup",
    ),
    *[
        HtmlBoard(
            tag, "",
            (Pick(tag="div", part="job"), *tags("article"), Pick(tag="div", part="card"),
             Pick(tag="div", part="listing"), Pick(tag="a", href="/job/")),
            (*_HEADS, *parts("title", "desig")), parts("company", "org"), parts("location", "loc"),
            default_company="Indian Startup", absolute_only=page, overrides={"remote_type": "onsite"},
        )
        for tag, page in [
            ("Naukri-Startups", "https://www.naukri.com/startup-jobs"),
            ("Shine-Startups", "https://www.shine.com/job-search/startup-jobs"),
            (
                "TimesJobs",
                "https://www.timesjobs.com/candidate/job-search.html?searchType=Home_Search&from=submit"
                "&txtKeywords=junior+developer+startup&cboWorkExp1=0&cboWorkExp2=2",
            ),
        ]
    ],
]
# Regional boards come first in a union, then the others in this order.
REGIONAL_SOURCES = [
    "Adzuna-IN-Junior", "Internshala", "Freshersworld", "CutShort", "Wellfound-IN",
    "Naukri-Startups", "Shine-Startups", "TimesJobs",
]
OTHER_SOURCES = [
    "YC-WATS", "YC-Jobs", "Simplify", "ArcDev", "Web3-DS", "Web3-Remote", "Web3-OKX", "MigrateMate",
    "Arbeitnow", "Remotive", "Remotive-AI", "HasJob", "Jobicy", "Himalayas", "RemoteOK", "AI-Jobs",
    "Karkidi", "Instahyre", "Adzuna-IN",
]


def source_rank(source: str) -> int:
    return (REGIONAL_SOURCES + OTHER_SOURCES).index(source)


class _Node:
    __slots__ = ("tag", "attrs", "items", "place", "elements", "parent", "end")

    def __init__(self, tag: str, attrs: dict, place: int, parent: "_Node | None" = None):
        self.tag, self.attrs, self.items, self.place, self.elements, self.parent = tag, attrs, [], place, 0, parent

    def text(self) -> str:
        """The texts within; unclosed tags may nest very deep."""
        if len(self.items) == 1 and isinstance(self.items[0], str):
            return self.items[0].strip()
        out, todo = [], list(reversed(self.items))
        while todo:
            item = todo.pop()
            if isinstance(item, str):
                out.append(item.strip())
            elif item.tag not in ("script", "style", "template"):
                todo.extend(reversed(item.items))
        return "".join(out)


#: Within < and >: a start tag, its attributes in double quotes and without references, or an end tag. Of these there is one reading only.
_PLAIN = re.compile(r'([a-z][a-z0-9]*)((?:[ \t\n]+[a-z][a-z0-9_-]*="[^"&<>]*")*)[ \t\n]*|/([a-z][a-z0-9]*)')
_PLAIN_ATTRIBUTE = re.compile(r'([a-z][a-z0-9_-]*)="([^"]*)"')
#: What stands in these may be no markup.
_RAW_TEXT = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}


class _Page(HTMLParser):
    """Element tree of a page; an end tag closes back to its start tag, as browsers' tolerant readers do.

    ``nodes`` are the elements in document order; those within the element at
    place ``i`` stand from ``i + 1`` to its ``end``. Plain tags are looked up in
    ``known``, which pages may share; the parser reads what is not plain.
    """

    _VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    _KEPT, _LONGEST = 1 << 12, 256

    def __init__(self, html: str, known: dict | None = None):
        super().__init__(convert_charrefs=True)
        self.known = {} if known is None else known
        self.open, self.nodes = [_Node("", {}, 0)], []
        at = self._read_plain(html)
        if at < len(html):
            self.feed(html[at:])
            self.close()
        for node in self.open:
            node.end = len(self.nodes)

    def _read_plain(self, html: str) -> int:
        """Read texts and plain tags from the start; where the first other thing stands."""
        known, opened = self.known, self.open
        before, *pieces = html.split("<")
        if before:
            opened[-1].items.append(unescape(before))
        at = len(before)
        for piece in pieces:
            inner, closed, data = piece.partition(">")
            found = known.get(inner) or self._plain(inner)
            if found is None or not closed:
                break
            name, attrs = found
            if attrs is None:
                self.handle_endtag(name)
            else:
                self.handle_starttag(name, attrs)
            if data:
                opened[-1].items.append(unescape(data) if "&" in data else data)
            at += len(piece) + 1
        return at

    def _plain(self, inner: str) -> "tuple[str, dict | None] | None":
        """Name and attributes of a plain start tag, name alone of an end tag; none of anything else."""
        found = _PLAIN.fullmatch(inner)
        if found is None or found[1] in _RAW_TEXT:
            return None
        out = (found[3], None) if found[3] else (found[1], dict(_PLAIN_ATTRIBUTE.findall(found[2])))
        if len(inner) <= self._LONGEST:
            if len(self.known) >= self._KEPT:
                self.known.clear()
            self.known[inner] = out
        return out

    def parse_starttag(self, i):
        end = self.rawdata.find(">", i)
        inner = self.rawdata[i + 1 : end]
        found = (self.known.get(inner) or self._plain(inner)) if end > 0 else None
        if found is None:
            return super().parse_starttag(i)
        self.handle_starttag(*found)
        return end + 1

    def updatepos(self, i, j):
        return j

    def handle_starttag(self, tag, attrs):
        parent = self.open[-1]
        parent.elements += 1
        node = _Node(tag, attrs if type(attrs) is dict else dict(attrs), parent.elements, parent)
        parent.items.append(node)
        self.nodes.append(node)
        if tag in self._VOID:
            node.end = len(self.nodes)
        else:
            self.open.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                for node in self.open[i:]:
                    node.end = len(self.nodes)
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].items.append(data)


CARD_FIELDS = "pos int, href string, title string, company string, location string, salary_text string"


class _CardReader:
    """Reads the cards of a board's pages. What an element's tag and classes tell of the board's tests is kept for the next one like it."""

    _KEPT = 1 << 12

    def __init__(self, board: HtmlBoard):
        self.board, self.known, self.tags = board, {}, {}
        wanted = {"cards": board.cards, "fallback": board.fallback, "title": board.title, "company": board.company, "location": board.location, "salary": board.salary, "link": (Pick(tag="a", href=""),)}
        self.wanted = {name: picks for name, picks in wanted.items() if picks}

    def _tests(self, tag: str, classes: str) -> tuple[list[str], list[tuple[str, list[Pick]]]]:
        """What such an element is for certain, and what it is if one of the tests named fits it."""
        sure, asked = [], []
        for name, picks in self.wanted.items():
            picks = [p for p in picks if p.fits_kind(tag, classes)]
            if any(not p.asks_more() for p in picks):
                sure.append(name)
            elif picks:
                asked.append((name, picks))
        if len(self.known) >= self._KEPT:
            self.known.clear()
        self.known[tag, classes] = found = sure, asked
        return found

    def _places(self, nodes: list[_Node]) -> dict[str, list[int]]:
        """For each wanted thing the places of the elements that fit it, in document order."""
        out = {name: [] for name in self.wanted}
        known = self.known
        for at, node in enumerate(nodes):
            kind = node.tag, node.attrs.get("class") or ""
            sure, asked = known.get(kind) or self._tests(*kind)
            for name in sure:
                out[name].append(at)
            for name, picks in asked:
                if any(p.fits_rest(node) for p in picks):
                    out[name].append(at)
        return out

    def cards(self, html: str, limit: int | None = None, by_link: bool = False) -> list[tuple]:
        """The raw texts of the cards; ``by_link`` keeps the first card of each link alone."""
        nodes = _Page(html or "", self.tags).nodes
        places = self._places(nodes)
        out, met = [], {None, ""}
        for pos, at in enumerate((places.get("cards") or places.get("fallback") or [])[:limit]):
            card = nodes[at]

            def first(name: str) -> "_Node | None":
                here = places.get(name, ())
                i = bisect_right(here, at)
                return nodes[here[i]] if i < len(here) and here[i] < card.end else None

            link = card if card.tag == "a" else first("link")
            href = (link.attrs.get("href") or "") if link is not None else None
            if by_link:
                if href in met:
                    continue
                met.add(href)
            title, company, place, pay = (n.text() if (n := first(name)) is not None else None for name in ("title", "company", "location", "salary"))
            if title is None and self.board.link_title and link is not None:
                title = link.text()
            out.append((pos, href, title, company, place, pay))
        for node in nodes:
            node.parent = None  # no cycles are left to the garbage collector
        return out


def page_cards(html: str, board: HtmlBoard, limit: int | None = None) -> list[tuple]:
    """Raw texts of a page's cards, or of the first ``limit``, in document order."""
    return _CardReader(board).cards(html, limit)


def extract_cards(pages: DataFrame, page: str, html: str, source: str, boards: list[HtmlBoard] = HTML_BOARDS, limit: int | None = None) -> DataFrame:
    """One row per card: page key, source and the raw card texts.

    Every page names its board in ``source``, so all boards take one pass. Boards
    that go by links give one row per link of a page, its first card.
    """
    names = [f.split()[0] for f in CARD_FIELDS.split(", ")]
    kind = pages.schema[page].dataType.simpleString()
    by_source = {b.source: b for b in boards}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        readers = {name: _CardReader(b) for name, b in by_source.items()}
        for pdf in batches:
            rows = [
                (key, name, *card)
                for key, name, body in zip(pdf[page], pdf[source], pdf[html])
                for card in readers[name].cards(body, limit, by_source[name].unique_links)
            ]
            yield pd.DataFrame(rows, columns=[page, source, *names])

    known = pages.where(F.col(source).isin(list(by_source)))
    return known.select(page, source, html).mapInPandas(run, f"{page} {kind}, {source} string, {CARD_FIELDS}")


def html_board_rows(pages: DataFrame, page: str, html: str, source: str, as_of, boards: list[HtmlBoard] = HTML_BOARDS, limit: int | None = None) -> DataFrame:
    """Canonical rows of all HTML boards from one page table.

    The boards' constants are a literal map on the source, so the cards of all
    boards go through one projection.
    """

    def constant(name: str) -> Column:
        return F.coalesce(lookup(F.col(source), {b.source: str(getattr(b, name)) for b in boards}), F.lit(""))

    def on(name: str) -> Column:
        return constant(name) == "True"

    def forced(name: str) -> Column | None:
        values = {b.source: str(b.overrides[name]).lower() for b in boards if name in b.overrides}
        return lookup(F.col(source), values) if values else None

    cards = extract_cards(pages, page, html, source, boards, limit)
    # A card without a link counts only on boards that do not go by links.
    link = F.when(on("unique_links"), F.nullif(F.col("href"), F.lit(""))).otherwise(F.col("pos").cast("string"))
    cards = cards.withColumn("_link", link).where("_link is not null")
    cards = top_per_group(cards, [page, source, "_link"], [F.col("pos")], 1)
    title, href = text_or_empty(F.col("title")), text_or_empty(F.col("href"))
    url = (
        F.when(constant("absolute_only") != "", F.when(F.startswith(href, F.lit("http")), href).otherwise(constant("absolute_only")))
        .when(on("join_any"), link_or_site(href, constant("origin")))
        .otherwise(resolve_href(href, constant("origin")))
    )
    kept = cards.where(F.length(title) >= constant("min_title").cast("int"))
    kept = kept.where(~on("need_company") | (text_or_empty(F.col("company")) != ""))
    raw = kept.select(
        page, source, "pos", title.alias("title"), first_filled(F.col("company"), constant("default_company")).alias("company"),
        F.coalesce(F.col("location"), constant("default_location")).alias("location"),
        F.coalesce(F.nullif(url, F.lit("")), constant("default_url")).alias("apply_url"),
        text_or_empty(F.col("salary_text")).alias("salary_text"), constant("remote_hint").alias("_hint"),
    )
    tags = {b.source: "|".join(b.overrides["tech_stack"]) for b in boards if "tech_stack" in b.overrides}
    overrides = {n: c for n in ("experience_level", "job_type", "remote_type") if (c := forced(n)) is not None}
    if (visa := forced("visa_sponsorship")) is not None:
        overrides["visa_sponsorship"] = visa.cast("boolean")
    if tags:
        overrides["tech_stack"] = F.split(lookup(F.col(source), tags), r"\|")
    return board_rows(raw, F.col(source), as_of, F.col("_hint"), (page, source, "pos"), overrides)


def page_links(pages: DataFrame, page: str, url: str, html: str, cap: int | None = None) -> DataFrame:
    """Links of flat pages in document order: built-in functions only, no Python.

    All links, or the first ``cap`` of a page. Links are resolved
    against the page's own site.
    """
    from listflow.functions.extract import site_origin

    found = anchors(F.col(html))
    found = F.slice(found, 1, cap) if cap else found
    rows = pages.select(page, url, F.explode(found).alias("_a")).select(page, url, "_a.*")
    return rows.withColumn("link", resolve_href(F.col("href"), site_origin(F.col(url))))


def usable_titles(df: DataFrame, title: str = "label", shortest: int = 4, company: str | None = None) -> DataFrame:
    """Drop rows whose title is shorter than ``shortest`` or whose company is missing."""
    kept = df.where(F.length(F.coalesce(F.col(title), F.lit(""))) >= shortest)
    return kept.where(~is_blank(F.col(company))) if company else kept
