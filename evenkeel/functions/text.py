"""Text and identifier normalisers for record linkage."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Identifier patterns.
ARXIV_DOI = "10.48550/arxiv."
DOI_PREFIX = r"^\s*(https?://(dx\.)?doi\.org/|doi:\s*)"
ARXIV_PREFIX = r"(?i)^(https?://arxiv\.org/(abs|pdf)/|arxiv:\s*)"

# Names of version types, and the words and document types that tell them.
JOURNAL, PREPRINT, CONFERENCE, OTHER = "JOURNAL_ARTICLE", "ARXIV_PREPRINT", "CONFERENCE_ABSTRACT", "OTHER"
CONFERENCE_WORDS = ("meeting abstracts", "general assembly", "bulletin of the american astronomical society",
                    "conference", "symposium", "annual meeting")
CONFERENCE_TYPES = ("inproceedings", "abstract")
OTHER_TYPES, OTHER_WORD = ("proposal", "software"), "nsf award"
DATA_WORD, DATA_CODE, DATA_TYPE = "vizier", "ycat", "dataset"
JOURNAL_FLAGS = ("REFEREED", "ARTICLE")


@F.pandas_udf(T.StringType())
def strip_accents(s: pd.Series) -> pd.Series:
    """Decompose and drop combining marks (Spark has no built-in for it)."""
    return s.map(lambda t: None if t is None else "".join(
        c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def parse_flag(x: Column) -> Column:
    """``true``/``True``/``false`` text to boolean; blank is NULL, anything else is false."""
    t = F.lower(F.trim(x))
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit(None).cast("boolean")).otherwise(t == "true")


def parse_number(x: Column) -> Column:
    """Finite double from text, else NULL."""
    v = x.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def doi(x: Column) -> Column:
    s = F.regexp_replace(F.lower(F.trim(x)), DOI_PREFIX, "")
    return F.regexp_replace(s, r"[ .;,]+$", "")


def is_arxiv_doi(x: Column) -> Column:
    return F.startswith(doi(x), F.lit(ARXIV_DOI))


def arxiv_from_doi(x: Column) -> Column:
    d = doi(x)
    return F.when(F.startswith(d, F.lit(ARXIV_DOI)), F.substr(d, F.lit(len(ARXIV_DOI) + 1))).otherwise("")


def arxiv_id(x: Column) -> Column:
    s = F.regexp_replace(F.trim(x), ARXIV_PREFIX, "")
    s = F.regexp_replace(s, r"(?i)\.pdf$", "")
    return F.regexp_replace(s, r"v[0-9]+$", "")


def arxiv_from_bibcode(x: Column) -> Column:
    a, b = (F.regexp_extract(x, r"arXiv([0-9]{4})([0-9]{5})", i) for i in (1, 2))
    return F.when(a != "", F.concat(a, F.lit("."), b)).otherwise("")


def arxiv_month(x: Column) -> Column:
    """``YYYY-MM`` encoded in a post-2007 identifier, blank if there is none."""
    pat = r"^([0-9]{2})([0-9]{2})\.[0-9]{4,5}"
    yy, mm = F.regexp_extract(x, pat, 1), F.regexp_extract(x, pat, 2)
    century = F.when(yy.try_cast("int") < 90, "20").otherwise("19")
    return F.when(yy != "", F.concat(century, yy, F.lit("-"), mm)).otherwise("")


def title(x: Column) -> Column:
    """Accent-free, lower case, runs of anything but letters and digits become one space."""
    x = F.coalesce(x, F.lit(""))
    plain = F.octet_length(x) == F.length(x)  # ASCII only: nothing to strip, and nothing for the Python worker to do
    s = F.lower(F.coalesce(F.when(plain, x), strip_accents(F.when(~plain, x))))
    return F.trim(F.regexp_replace(s, r"[^a-z0-9]+", " "))


def listed(x: Column) -> Column:
    """JSON array of texts, or one bare text, to ``array<string>``; blank gives an empty array."""
    t = F.trim(x)
    arr = F.when(F.startswith(t, F.lit("[")), F.from_json(t, "array<string>"))
    scalar = F.when(F.coalesce(t, F.lit("")) != "", F.array(F.regexp_replace(t, r'^"(.*)"$', "$1")))
    empty = F.array().cast("array<string>")
    return F.filter(F.coalesce(arr, scalar, empty), lambda v: F.coalesce(F.trim(v), F.lit("")) != "")


def first_author(authors: Column) -> Column:
    head = F.when(F.startswith(F.trim(authors), F.lit("[")),
                  F.try_element_at(F.from_json(authors, "array<string>"), F.lit(1)))
    head = F.coalesce(head, F.split_part(authors, F.lit(";"), F.lit(1)), F.lit(""))
    return F.lower(F.trim(F.split_part(head, F.lit(","), F.lit(1))))


def authors_text(authors: Column) -> Column:
    arr = F.when(F.startswith(F.trim(authors), F.lit("[")), F.from_json(authors, "array<string>"))
    return F.coalesce(F.array_join(arr, "; "), authors, F.lit(""))


def clean_date(x: Column) -> Column:
    """Drop the time part, else drop unknown ``-00`` parts; mixed precision is kept as text."""
    s = F.coalesce(x, F.lit(""))
    return F.when(F.contains(s, F.lit("T")), F.split_part(s, F.lit("T"), F.lit(1))).otherwise(
        F.trim(F.replace(s, F.lit("-00"), F.lit(""))))


def version_type(source: Column, pub: Column, doctype: Column, props: Column, bibcode: Column,
                 journal_dois: Column) -> Column:
    """Kind of publication a record stands for."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    p, d, b = low(pub), low(doctype), low(bibcode)
    has = lambda c, *words: F.coalesce(
        F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w)), F.lit(False))
    flags = F.transform(F.coalesce(props, F.array().cast("array<string>")), F.upper)
    return (F.when(source == "ARXIV", PREPRINT)
            .when(has(p, "arxiv") | has(b, "arxiv"), PREPRINT)
            .when(has(p, DATA_WORD) | has(b, DATA_CODE) | (d == DATA_TYPE), OTHER)
            .when(d.isin(*CONFERENCE_TYPES) | has(p, *CONFERENCE_WORDS), CONFERENCE)
            .when(d.isin(*OTHER_TYPES) | has(p, OTHER_WORD), OTHER)
            .when(F.arrays_overlap(flags, F.array(*[F.lit(f) for f in JOURNAL_FLAGS])) | (F.size(journal_dois) > 0), JOURNAL)
            .otherwise(OTHER))


def peer_status(vtype: Column, refereed: Column) -> Column:
    return (F.when((vtype == "JOURNAL_ARTICLE") & refereed, "PEER_REVIEWED")
            .when(vtype == "JOURNAL_ARTICLE", "PUBLISHED_JOURNAL")
            .when(vtype == "ARXIV_PREPRINT", "PREPRINT")
            .when(vtype == "CONFERENCE_ABSTRACT", "NOT_PEER_REVIEWED")
            .otherwise("NOT_APPLICABLE"))


def version_key(x: Column, width: int = 8) -> Column:
    """Numbers inside a dotted version text as a zero-padded, comparable array."""
    nums = F.transform(F.regexp_extract_all(x, F.lit(r"([0-9]+)"), F.lit(1)), lambda v: v.cast("bigint"))
    return F.slice(F.concat(nums, F.array_repeat(F.lit(0).cast("bigint"), width)), 1, width)


def is_product_name(name: Column, sector: Column, target: Column, ending: str = "_fast-lc.fits") -> Column:
    """Exact product-name test with zero-padded sector and target numbers."""
    name = F.lower(name)
    return (F.contains(name, F.format_string("-s%04d-", sector.cast("int")))
            & F.contains(name, F.format_string("-%016d-", target.cast("bigint")))
            & F.endswith(name, F.lit(ending)))


def id_list(x: Column, sep: str = ";") -> Column:
    """Multi-valued id text to array, without blanks and placeholder words."""
    skip = ("", "NONE", "NOT_APPLICABLE", "NOT_REPORTED")
    return F.filter(F.split(F.coalesce(x, F.lit("")), sep), lambda v: ~v.isin(*skip))
