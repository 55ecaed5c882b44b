"""Page types from URL, title and H1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx
from . import urls

#: (type, path segments, words of title or H1), in order of precedence.
TYPES = (
    ("pricing", ("pricing", "plans")), ("about", ("about", "team")), ("contact", ("contact",)), ("faq", ("faq",)),
    ("docs", ("docs", "documentation")), ("services_product", ("services", "service", "products", "product")), ("blog", ("blog",)),
)


def page_type(url: Column, title: Column, h1: Column) -> Column:
    path = F.regexp_replace(F.lower(urls.path_of(url)), "^/+|/+$", "")
    own = urls.segments(url)
    words = F.lower(F.concat_ws(" ", F.when(title != "", title), F.when(h1 != "", h1)))
    out = F.when(F.startswith(urls.host_of(url), F.lit("docs.")) | tx.contains_any(words, ("documentation", "developer docs")), "docs").when(path.isin("", "home", "index"), "homepage")
    for name, parts in TYPES:
        out = out.when(F.arrays_overlap(own, F.array(*map(F.lit, parts))), name)
    for name, parts in TYPES:
        out = out.when(tx.contains_any(words, parts), name)
    return out.otherwise("generic")
