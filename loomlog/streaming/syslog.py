"""Streaming source ``loomlog-syslog``: a TCP or UDP syslog server.

The reader listens in the driver's source process.  Messages wait in a bounded queue, which holds senders back when full (TCP)
or makes datagrams wait in the socket (UDP), and stay until Spark commits them.  Each read takes whole multiples of
``batch_size`` if there are that many, and everything otherwise, so a tick flushes a partial batch unless full ones went
out.  Socket data can't be read again, so delivery is at most once after a crash of the driver.
"""

from __future__ import annotations

import os
import select
import socket
import threading
import time
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from .lines import LineBuffer

NAME = "loomlog-syslog"
SCHEMA = "_seq long, _file string, _raw string"
MAX_DATAGRAM = 64 * 1024
#: Most seconds that are spent on data still arriving from senders that don't stop, once the server is told to close.
LINGER = 2.0


class SyslogServer:
    """Listener thread that gathers messages of all senders."""

    def __init__(self, proto: str, host: str, port: int, merge: bool = False, idle_timeout: float = 30.0, channel_size: int = 1000, close_file: str | None = None):
        if proto not in ("tcp", "udp"):
            raise ValueError(f"unknown protocol {proto!r}")
        family = socket.getaddrinfo(host, port, type=socket.SOCK_STREAM if proto == "tcp" else socket.SOCK_DGRAM)[0][0]
        self.proto, self.merge, self.idle_timeout = proto, merge, idle_timeout
        self.socket = socket.socket(family, socket.SOCK_STREAM if proto == "tcp" else socket.SOCK_DGRAM)
        self.socket.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
        self.socket.bind((host, port))
        if proto == "tcp":
            self.socket.listen(64)
        self.capacity = max(1, channel_size)
        self.changed = threading.Condition()
        self.messages: list[tuple[str, str]] = []
        self.first = 0  # number of the first message still kept
        self.taken = 0  # number of the first message not yet read
        self.running = True
        self.close_file = close_file
        self.closing = False
        self.deadline = time.monotonic() + LINGER
        self.buffers: dict[object, LineBuffer] = {}
        self.peers: dict[socket.socket, str] = {}
        self.thread = threading.Thread(target=self._serve, daemon=True)
        self.thread.start()

    def _put(self, sender: str, messages: list[str]) -> None:
        with self.changed:
            for m in messages:
                while self.running and self.first + len(self.messages) - self.taken >= self.capacity:
                    self.changed.wait(0.5)
                self.messages.append((sender, m))

    def _serve(self) -> None:
        serve = self._serve_tcp if self.proto == "tcp" else self._serve_udp
        while self.running:
            try:
                serve()
                break
            except OSError:
                if self.running:
                    time.sleep(0.05)

    def _open(self) -> bool:
        """Whether more is to be received."""
        self.closing = self.closing or bool(self.close_file and os.path.exists(self.close_file))
        if self.running and not self.closing:
            self.deadline = time.monotonic() + LINGER
            return True
        return False

    def _finish(self, buffers: list[tuple[str, LineBuffer]]) -> None:
        """What buffers still hold, as their senders won't go on."""
        self.socket.close()
        for name, buffer in buffers:
            self._put(name, buffer.flush())
        self.buffers.clear()
        if self.close_file and os.path.exists(self.close_file):
            os.remove(self.close_file)  # tells that all messages wait in the queue

    def _serve_tcp(self) -> None:
        """Connections are read in turn; an error of one ends that one only."""
        peers = self.peers
        while True:
            # what has arrived is still read after the server was told to close
            more = self._open()
            ready = select.select([self.socket, *peers], [], [], 0.1 if more else 0)[0]
            if not more and not ready:
                break
            for s in ready:
                if s is self.socket:
                    peer, address = s.accept()
                    peers[peer] = f"{address[0]}:{address[1]}"
                    self.buffers[peer] = LineBuffer(self.merge)
                    continue
                try:
                    data = s.recv(MAX_DATAGRAM)
                except OSError:
                    data = b""
                name = peers[s]
                if data:
                    self._put(name, self.buffers[s].feed(data))
                else:
                    self._put(name, self.buffers.pop(s).flush())
                    peers.pop(s)
                    s.close()
            if not more and time.monotonic() > self.deadline:
                break
        self._finish([(peers[s], b) for s, b in self.buffers.items()])
        for s in peers:
            s.close()

    def _serve_udp(self) -> None:
        while True:
            more = self._open()
            ready = select.select([self.socket], [], [], 0.1 if more else 0)[0]
            if not more and (not ready or time.monotonic() > self.deadline):
                break
            if ready:
                data, address = self.socket.recvfrom(MAX_DATAGRAM)
                buffer = self.buffers.setdefault(address, LineBuffer(self.merge))
                self._put(f"{address[0]}:{address[1]}", buffer.feed(data))
            self._expire(time.monotonic() - self.idle_timeout)
        self._finish([(f"{a[0]}:{a[1]}", b) for a, b in self.buffers.items()])

    def _expire(self, before: float) -> None:
        for address in [a for a, b in self.buffers.items() if b.touched < before]:
            self._put(f"{address[0]}:{address[1]}", self.buffers.pop(address).flush())

    def take(self, start: int, batch_size: int) -> tuple[list[tuple[int, str, str]], int]:
        """Messages from number ``start`` on, and the number after the last one."""
        with self.changed:
            ready = self.first + len(self.messages) - start
            n = ready // batch_size * batch_size if batch_size and ready >= batch_size else max(0, ready)
            out = self.between(start, start + n)
            self.taken = max(self.taken, start + n)
            self.changed.notify_all()
        return out, start + n

    def between(self, start: int, end: int) -> list[tuple[int, str, str]]:
        kept = self.messages[max(0, start - self.first) : max(0, end - self.first)]
        return [(max(start, self.first) + i, sender, m) for i, (sender, m) in enumerate(kept)]

    def commit(self, end: int) -> None:
        with self.changed:
            del self.messages[: max(0, end - self.first)]
            self.first = max(self.first, end)
            self.changed.notify_all()

    def stop(self) -> None:
        """Closes the listener.  What has arrived and what buffers hold is then among the messages, which can still be read."""
        self.running = False
        with self.changed:
            self.changed.notify_all()
        self.thread.join(LINGER + 2)
        self.socket.close()


class SyslogReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.server: SyslogServer | None = None
        self.batch_size = int(options.get("batchsize", "0"))

    def _open(self) -> SyslogServer:
        if self.server is None:
            o = self.options
            self.server = SyslogServer(o.get("proto", "tcp"), o.get("host", "127.0.0.1"), int(o["port"]), o.get("merge", "false") == "true", float(o.get("idletimeout", "30")), int(o.get("channelsize", "1000")), o.get("closefile"))
        return self.server

    def initialOffset(self) -> dict:
        self._open()
        return {"next": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._open().take(int(start["next"]), self.batch_size)
        return iter(rows), {"next": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        # called away from the listener for an empty first batch, or after a restart, when the data is gone
        if self.server is None:
            return iter(())
        with self.server.changed:
            return iter(self.server.between(int(start["next"]), int(end["next"])))

    def commit(self, end: dict) -> None:
        if self.server is not None:
            self.server.commit(int(end["next"]))


class SyslogSource(DataSource):
    """Options: ``proto`` (tcp, udp), ``host``, ``port``, ``merge``, ``batchSize``, ``idleTimeout``, ``channelSize``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> SyslogReader:
        options = {k.lower(): v for k, v in self.options.items()}
        if options.get("proto", "tcp") not in ("tcp", "udp"):
            raise ValueError(f"unknown protocol {options['proto']!r}")
        if "port" not in options:
            raise ValueError("the port option is needed")
        return SyslogReader(options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SyslogSource)
