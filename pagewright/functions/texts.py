"""Text functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def word_count(text: Column) -> Column:
    """Words cut at white space; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")), F.lit(0))


def raw_word_count(html: Column) -> Column:
    """Words once tags are taken away; those of scripts count."""
    return word_count(F.regexp_replace(html, "<[^>]+>", " "))


def reading_time(words: Column, per_minute: int = 200) -> Column:
    return F.greatest(F.lit(1), F.ceil(words / per_minute)).cast("int")


def content_hash(text: Column) -> Column:
    """16 hex digits of SHA-256 over the first 5,000 characters without white space around."""
    return F.substring(F.sha2(F.substring(stripped(text), 1, 5000), 256), 1, 16)


def without_templates(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<template\b[^>]*>.*?</template>", "")


def markdown_document(title: Column, author: Column, published: Column, tags: Column, summary: Column, body: Column) -> Column:
    """An article as one Markdown text; lines of what is null or empty are left out."""

    def line(before: str, value: Column, after: str = "") -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(before), value, F.lit(after)))

    facts = F.concat_ws("\n", line("**Author:** ", author), line("**Published:** ", published), line("**Tags:** ", F.array_join(tags, ", ")))
    return F.concat_ws("\n\n", line("# ", title), F.when(facts != "", facts), line("> ", summary), F.lit("---"), F.coalesce(body, F.lit("")))
