"""Links of listing pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The value of href in an anchor: between quotes of either kind, or up to a space.
HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
# The entities that occur in addresses, the ampersand last.
ENTITIES = (("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def page_links(html: Column) -> Column:
    def value(found: Column) -> Column:
        found = F.regexp_replace(found, r"""^["']|["']$""", "")
        for entity, character in ENTITIES:
            found = F.replace(found, F.lit(entity), F.lit(character))
        return found

    return F.transform(F.regexp_extract_all(html, F.lit(HREF), F.lit(1)), value)


def extract_links(pages: DataFrame, suffix: str = ".zip", base: str = "") -> DataFrame:
    """Absolute URLs of the links ending in ``suffix``, last link first.

    ``ordem`` 1 is the newest file of a listing that is sorted by date.
    """
    wanted = F.filter(page_links(F.col("html")), lambda link: F.endswith(link, F.lit(suffix)))
    numbered = F.posexplode(F.reverse(wanted)).alias("_pos", "_link")
    return pages.select("page_id", numbered).select(
        "page_id",
        (F.col("_pos") + 1).cast("long").alias("ordem"),
        F.concat(F.lit(base), F.col("_link")).alias("url"),
    )
