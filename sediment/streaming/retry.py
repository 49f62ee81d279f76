"""Work that lost a race for a commit is worked out again from the new state."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from typing import TypeVar

from sediment.sources.versioned import CommitConflict

Result = TypeVar("Result")

#: Seconds to wait before each further try.
PAUSES = (5.0, 10.0)


def with_retry(work: Callable[[], Result], pauses: Iterable[float] = PAUSES, sleep: Callable[[float], None] = time.sleep) -> Result:
    """The result of ``work``, tried again after each pause while another writer's commit comes first."""
    for pause in pauses:
        try:
            return work()
        except CommitConflict:
            sleep(pause)
    return work()
