"""How a site is asked: spacing of requests, which failures are tried again, and pages that block.

The transport is injected (a callable that answers with a status and a body), and so are clock and pause, so that the
policy is the same for a browser, an HTTP client or a table of recorded answers, and can be tested without a network.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import NamedTuple

from partmill.errors import WebError

# Statuses that may pass, pauses in seconds before the tries, least seconds between requests.
PASSING = frozenset({429, 500, 502, 503, 504})
PAUSES = (0.0, 1.0, 2.0)
SPACING = 0.5
# Texts by which a page that blocks is known, in its title and in its body.
BLOCKED_TITLES = ("attention required", "just a moment")
BLOCKED_BODIES = ("you have been blocked",)


class Answer(NamedTuple):
    """What a transport gives; a transport that can't reach the site raises."""

    status: int
    body: str
    title: str = ""


def is_blocked(title: str | None, body: str | None) -> bool:
    """Whether a page is a block page instead of content."""
    return any(t in (title or "").lower() for t in BLOCKED_TITLES) or any(t in (body or "").lower() for t in BLOCKED_BODIES)


@dataclass
class Fetcher:
    """Requests one after another, at least ``spacing`` seconds apart."""

    transport: Callable[[str], Answer]
    clock: Callable[[], float] = time.monotonic
    pause: Callable[[float], None] = time.sleep
    spacing: float = SPACING
    last: float = field(default=float("-inf"), init=False)

    def ask(self, url: str) -> Answer:
        wait = self.spacing - (self.clock() - self.last)
        if wait > 0:
            self.pause(wait)
        self.last = self.clock()
        return self.transport(url)

    def establish(self, url: str) -> None:
        """Opens a site; an error if it answers with a block page."""
        answer = self.ask(url)
        if is_blocked(answer.title, answer.body):
            raise WebError("The site blocks automated requests. Wait some minutes before the next try.")

    def page(self, url: str) -> str:
        """A page's text; statuses from 400 on are errors and are not tried again."""
        answer = self.ask(url)
        if answer.status >= 400:
            raise refused(answer.status)
        return answer.body

    def text(self, url: str) -> str:
        """A file's text; every status but 200 is an error."""
        answer = self.ask(url)
        if answer.status != 200:
            raise refused(answer.status)
        return answer.body

    def document(self, url: str) -> dict:
        """A JSON document.  Failures of the connection and passing statuses are tried again after a pause; other
        statuses and answers that are no JSON are final."""
        problem = WebError("The site does not respond.")
        for pause in PAUSES:
            if pause:
                self.pause(pause)
            try:
                answer = self.ask(url)
            except Exception:  # noqa: BLE001 - any failure of a transport may pass
                problem = WebError("The site does not respond.")
                continue
            if answer.status == 200:
                try:
                    return json.loads(answer.body)
                except ValueError:
                    raise WebError("The site's answer is no JSON document.") from None
            problem = refused(answer.status)
            if answer.status not in PASSING:
                break
        raise problem


def refused(status: int) -> WebError:
    return WebError(f"The site answered with status {status}.")
