"""A deterministic stand-in for a model."""

import json
import re

from eventloom.operators.inference import Completion

_ISO_DAY = re.compile(r"\d{4}-\d{2}-\d{2}")
_SCORE_ID = re.compile(r'"id":(\d+)')


def offline_completer(prompt: str) -> Completion:
    """One event per line with an ISO day, one score per listed id, else a one-line summary."""
    _, is_page, page = prompt.partition("PAGE TEXT:\n")
    if is_page:
        lines = [(line, _ISO_DAY.search(line)) for line in page.splitlines()]
        events = [{"title": line[: day.start()].strip(" -|") or line, "date": day[0]} for line, day in lines if day]
        content = json.dumps({"events": events, "next_page_url": None})
    elif ids := _SCORE_ID.findall(prompt):
        content = json.dumps([{"id": int(i), "score": int(i) % 11 / 10} for i in ids])
    else:
        content = f"Summary of {len(prompt.splitlines())} lines"
    return Completion(content, int(len(prompt) / 2.2), int(len(content) / 2.2))
