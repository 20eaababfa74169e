"""Line buffers of connections: bytes in, complete messages out."""

from __future__ import annotations

import re
import time

_PRIORITY = re.compile(r"^<[0-9]*>")


class LineBuffer:
    """Bytes of one sender.  Lines end at a line feed or carriage return; an unfinished one and, when merging,
    the message that may still go on are held back until :meth:`flush`."""

    def __init__(self, merge: bool = False):
        self.merge = merge
        self.tail = b""
        self.held: list[str] = []
        self.touched = time.monotonic()

    def feed(self, data: bytes) -> list[str]:
        self.touched = time.monotonic()
        parts = re.split(rb"[\r\n]+", self.tail + data)
        self.tail = parts.pop()
        return self._messages(parts)

    def flush(self) -> list[str]:
        """Everything that is held, as the sender won't go on."""
        out = self._messages([self.tail])
        self.tail = b""
        if self.held:
            out.append(" ".join(self.held))
            self.held = []
        return out

    def _messages(self, parts: list[bytes]) -> list[str]:
        out = []
        for part in parts:
            line = _PRIORITY.sub("", part.decode("utf-8", "replace"))
            if not line:
                continue
            if not self.merge:
                out.append(line)
            elif line[0] in " \t" and self.held:
                self.held.append(line)
            else:
                if self.held:
                    out.append(" ".join(self.held))
                self.held = [line]
        return out
