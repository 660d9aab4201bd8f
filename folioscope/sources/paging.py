"""Harvests from a paged service: a callable gives (rows, total) of a skip and a size.  Driver side, as the service is."""

from __future__ import annotations

import time
from collections.abc import Callable

from folioscope.plans.gateway import QueryError

# Rows of a page, most rows of a harvest, waits before a page is tried again, items of a batch.
PAGE, CAP, WAITS, BATCH = 200, 5000, (2, 4, 8), 100
Fetch = Callable[[int, int], tuple[list, int | None]]


def retried(call: Callable, waits=WAITS, sleep=time.sleep):
    """The call's result, tried again after each wait; the last error where none succeeds."""
    for wait in (*waits, None):
        try:
            return call()
        except Exception:
            if wait is None:
                raise
            sleep(wait)


def harvest(fetch: Fetch, num: int | None = None, page: int = PAGE, cap: int = CAP, waits=WAITS, sleep=time.sleep) -> dict:
    """Rows page by page until the total, ``num`` or ``cap`` is reached or a page is short.

    A page that fails for good ends the harvest: what has landed stays, with ``resume`` where to go on.  A total of 0 is a
    true zero.
    """
    want, rows, total, failed = min(num or cap, cap), [], None, None
    while len(rows) < want:
        size = min(page, want - len(rows))
        try:
            got, total = retried(lambda size=size: fetch(len(rows), size), waits, sleep)
        except Exception as e:  # noqa: BLE001
            failed = str(e)
            break
        rows += got
        if len(got) < size or total is not None and len(rows) >= total:
            break
    done = failed is None and (total is None or len(rows) >= total)
    return {"rows": rows, "total": total, "complete": done, "true_zero": failed is None and not rows, "error": failed, "resume": None if done else len(rows)}


def bulk_axis(fetch: Callable[..., tuple[list, int | None]], query: dict, **kw) -> dict:
    """A harvest along a class axis: one of cpc, ipc and uspc is required; the keyword takes no part."""
    axes = {k: v for k, v in query.items() if k in ("cpc", "ipc", "uspc") and v}
    if not axes:
        raise QueryError("a bulk export needs a class axis")
    rest = {k: v for k, v in query.items() if k != "keyword"}
    return harvest(lambda skip, size: fetch(skip=skip, num=size, **rest), **kw)


def walk(fetch: Callable[[int], list], key: Callable, most: int) -> dict:
    """Pages 1, 2, ... until one is empty or shows only what was seen (complete), or ``most`` pages are read (truncated)."""
    seen, rows = set(), []
    for k in range(1, most + 1):
        new = [r for r in fetch(k) if key(r) not in seen]
        if not new:
            return {"rows": rows, "pages": k - 1, "state": "complete"}
        seen.update(map(key, new))
        rows += new
    return {"rows": rows, "pages": most, "state": "truncated"}


def batched(items: list, call: Callable, budget: float, most: int = BATCH, clock=time.monotonic) -> dict:
    """Results of the first ``most`` items within a time budget, and the items that remain."""
    began, done = clock(), {}
    for k, item in enumerate(items[:most]):
        if clock() - began >= budget:
            return {"done": done, "remaining": items[k:]}
        done[item] = call(item)
    return {"done": done, "remaining": items[most:]}


def ladder(sources: dict[str, Callable], wanted: set[str], only: dict[str, set[str]], query) -> dict:
    """The first source with hits; sources that don't serve the wanted jurisdictions are passed over; misses say why.

    only: jurisdictions a source is bound to.  A source that holds other jurisdictions than the wanted ones is no answer.
    """
    misses = {}
    for name, ask in sources.items():
        if wanted and name in only and not wanted & only[name]:
            misses[name] = "not_served"
            continue
        try:
            hits = ask(query)
        except Exception as e:  # noqa: BLE001
            misses[name] = f"error: {e}"
            continue
        if hits:
            return {"source": name, "hits": hits, "misses": misses}
        misses[name] = "zero_hits"
    return {"source": None, "hits": [], "misses": misses}
