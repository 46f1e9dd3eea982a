"""The language model as a callable, and tolerant reading of what it answers.

A model is any object with ``ask(task, content, tokens)`` that gives a JSON object; :class:`TextModel` makes one of a
function from two texts to a text.  Answers are read field by field: what has the wrong type is left out, never an error,
but for the field without which an answer says nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from partmill.errors import LLMError, PdfError

CONTENTS_TASK = "List the sections that the table of contents of a parts catalog names. Answer with one JSON object: {\"sections\": [{\"name\", \"category\", \"start_page\", \"end_page\" or null}]} in the order of their first pages, with the printed page numbers and the kind of product as category."
PAGE_TASK = "List the parts that a page of a parts catalog prints with a number; copy each number exactly and add none. Answer with one JSON object: {\"subcategory\": the page's heading, \"parts\": [{\"part_no\", \"series\": the heading above it, \"description\": its other columns as Label: value}], \"skip_reason\": why there are no parts, or null}."


class Model(Protocol):
    def ask(self, task: str, content: str, tokens: int = 4096) -> dict: ...


@dataclass
class TextModel:
    """A model behind a function (task, content, tokens) -> text."""

    complete: Callable[[str, str, int], str]

    def ask(self, task: str, content: str, tokens: int = 4096) -> dict:
        try:
            text = self.complete(task, content, tokens)
        except Exception as error:
            raise LLMError("The model can't be reached.") from error
        try:
            return json.loads(text)
        except (TypeError, ValueError) as error:
            raise LLMError("The model's answer is no JSON document.") from error


def sections_of(model: Model) -> Callable[[str, int], list[tuple]]:
    """The reader of tables of contents for ``runs.run_pages``: (ord, name, category, start_page, end_page) rows.

    An answer without a list of sections is an error; ``catalog.clean_sections`` drops pages that are no numbers.
    """

    def read(text: str, total: int) -> list[tuple]:
        answer = model.ask(CONTENTS_TASK, text)
        listed = answer.get("sections") if isinstance(answer, dict) else None
        if not isinstance(listed, list):
            raise PdfError("The table of contents can't be understood.")
        return [(n, *(str(item.get(k) or "") for k in ("name", "category")), item.get("start_page"), item.get("end_page")) for n, item in enumerate(listed) if isinstance(item, dict)]

    return read


def extractor_of(model: Model) -> Callable[[str, int, str], dict]:
    """The reader of pages for ``pages.page_results``."""

    def read(text: str, page_no: int, category: str) -> dict:
        answer = model.ask(PAGE_TASK, f"Page {page_no}, category: {category or 'not known'}\n\n{text}", 16_000)
        listed = answer.get("parts")
        return {"subcategory": answer.get("subcategory"), "parts": listed if isinstance(listed, list) else [], "skip_reason": answer.get("skip_reason")}

    return read
