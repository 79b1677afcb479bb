"""Progress and log callbacks."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

Handler = Callable[[str, str, str], None]


def duration_text(ms: float | None) -> str:
    """Days, hours and minutes where there are any, and seconds always."""
    s = int((ms or 0) // 1000)
    parts = ((s // 86400, "天"), (s % 86400 // 3600, "小时"), (s % 3600 // 60, "分钟"))
    return "".join(f"{n}{unit}" for n, unit in parts if n) + f"{s % 60}秒"


class Progress:
    """Calls handler(percent, "done / total", time left), at most once a second, and at the end. A total of 0 is done at once."""

    def __init__(self, total: int, handler: Handler | None = None, every: float = 1.0, clock: Callable[[], float] = time.monotonic):
        self.total, self.done, self.handler, self.every, self.clock = total, 0, handler, every, clock
        self.began, self.told = clock(), float("-inf")
        if handler and not total:
            handler("1.0000", "0 / 0", duration_text(0))

    def step(self, n: int = 1) -> None:
        self.done += n
        now = self.clock()
        if self.handler and (self.done >= self.total or now - self.told >= self.every):
            self.told = now
            left = (now - self.began) / self.done * (self.total - self.done) * 1000 if self.done else 0
            self.handler(f"{self.done / self.total:.4f}" if self.total else "1.0000", f"{self.done} / {self.total}", duration_text(left))


logger = logging.getLogger("sameleaf")


class _Custom(logging.Handler):
    def __init__(self, handle: Callable[[str], None]):
        super().__init__()
        self.handle_text = handle

    def emit(self, record: logging.LogRecord) -> None:
        self.handle_text(self.format(record))


def set_log_handler(handle: Callable[[str], None] | None) -> None:
    """Lines go to the function instead; None takes it away."""
    for h in [h for h in logger.handlers if isinstance(h, _Custom)]:
        logger.removeHandler(h)
    if handle:
        own = _Custom(handle)
        formatter = logging.Formatter("%(asctime)s %(message)s", "%Y-%m-%d %H:%M:%S")
        formatter.converter = time.gmtime
        own.setFormatter(formatter)
        logger.addHandler(own)
        logger.setLevel(logging.INFO)
