"""Column functions over text. Patterns follow Unicode classes and treat only a line feed as a line's end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words, patterns and templates that decide results.
STOP_WORDS = "what is the a an of and in to about for on with how are does do can this that it be was were has have had".split()
TOKEN = r"[a-z](?:-[a-z0-9]+)+|[a-z0-9]+"
CAPTION = r"(?iU)((?:Fig(?:ure)?|Table)\.?\s*\d+[a-z]?[.:]\s*[^\n]{5,120})"
LABEL = r"(?iU)^((?:Fig(?:ure)?|Table)\.?\s*\d+[a-z]?)"
HEADING = r"(?dU)^(#{1,6})\s+(.*)$"
PAGE_TAG = r"\[\[PAGE_(\d+)\]\]"
PAGE_MARKER = r"(?U)---\s*Page\s*(\d+)\s*---"
IMAGE_TAG = r"!\[(.*?)\]\(.*?\)"
VISUAL = r"(?dU)\[Visual Component\] Caption:\s*(.*?)(?:\n|$)"
FIGURE_QUERY = r"(?U)fig(?:ure)?\.?\s*(\d+)"
INTENT = "fig(?:ure)?|chart|image|graph|plot|table|show"
NO_CAPTION = "Aucune légende trouvée"
NO_TAG_CAPTION = "No caption detected."
NAVIGATION = """You are a document navigation assistant. Find which sections contain the answer to the query.

Think step-by-step:
1. Read the query carefully.
2. Scan each node's title, preview text, and figure_captions.
3. Select 1-2 node IDs most likely to contain the answer.

Query: {query}

Document structure:
{entries}

Reply ONLY in this exact JSON format, no markdown, no extra text:
{
  "thinking": "<your reasoning>",
  "node_list": ["node_id1", "node_id2"]
}"""
ANSWERING = """You are an advanced AI assistant running locally.
Answer the user query based strictly on the context and any attached visual data below.

Query: {query}

Context:
{context}"""


def stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def collapsed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def terms(x: Column) -> Column:
    """Search terms: one-letter compounds and words of over two characters, without stop words."""
    found = F.regexp_extract_all(F.lower(x), F.lit(f"({TOKEN})"), F.lit(1))
    return F.filter(found, lambda t: ~t.isin(STOP_WORDS) & ((F.length(t) > 2) | F.contains(t, F.lit("-"))))


def normalized_label(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), r"(?U)[.\s]", "")


def safe_title(x: Column) -> Column:
    return F.regexp_replace(x, r'["\\\x00-\x1f]', "")


def filled(template: str, **values: Column) -> Column:
    """The template with a column's value in place of each {name}."""
    parts, rest = [], template
    for name, value in values.items():
        before, rest = rest.split("{" + name + "}", 1)
        parts += [F.lit(before), value]
    return F.concat(*parts, F.lit(rest))


def host(url: Column) -> Column:
    """The host of a URL, with its port if it has one."""
    return F.try_parse_url(url, F.lit("AUTHORITY"))
