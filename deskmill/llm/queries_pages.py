"""Queries over web pages."""

from __future__ import annotations

from deskmill.llm import html_text
from deskmill.llm.registry import query


@query("op7_html_text")
def op7(t):
    return html_text.extract_text(t.pages).select("page_id", "url", "text", "n_chars")
