"""The syslog source over loop-back sockets."""

import socket
import time

import pytest
from pyspark.sql import functions as F

from loomlog.config import EngineConfig, parse_column
from loomlog.engine import run_stream, stop_stream
from loomlog.streaming.syslog import SyslogServer


def free_port(kind=socket.SOCK_STREAM):
    with socket.socket(socket.AF_INET, kind) as s:
        s.bind(("127.0.0.1", 0))
        return s.getsockname()[1]


def wait_for(ready, seconds=30):
    end = time.time() + seconds
    while not ready():
        assert time.time() < end, "timed out"
        time.sleep(0.1)


def send_tcp(port, *parts):
    end = time.time() + 30
    while True:
        try:
            s = socket.create_connection(("127.0.0.1", port))
            break
        except OSError:
            assert time.time() < end
            time.sleep(0.1)
    for p in parts:
        s.sendall(p)
    s.close()


def test_tcp_connections_and_tail():
    server = SyslogServer("tcp", "127.0.0.1", port := free_port(), merge=True)
    try:
        send_tcp(port, b"<13>a", b"bc\n\tmore\r\nx", b"y")
        send_tcp(port, b"second")
        wait_for(lambda: len(server.messages) >= 3)
        assert sorted(m for _, m in server.messages) == ["abc \tmore", "second", "xy"]
        rows, end = server.take(0, 2)
        assert len(rows) == 2 and end == 2
        assert [r[0] for r in server.take(2, 2)[0]] == [2]
        server.commit(2)
        assert server.between(2, 3) == [(2, *server.messages[0])]
    finally:
        server.stop()


def test_udp_senders_expire():
    server = SyslogServer("udp", "127.0.0.1", port := free_port(socket.SOCK_DGRAM), merge=True, idle_timeout=0.3)
    try:
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as a, socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as b:
            a.sendto(b"one ", ("127.0.0.1", port))
            b.sendto(b"other\n", ("127.0.0.1", port))
            a.sendto(b"two\n\tx", ("127.0.0.1", port))
            wait_for(lambda: len(server.messages) >= 2)
        assert sorted(m for _, m in server.messages) == ["one two \tx", "other"]
    finally:
        server.stop()


def test_full_queue_holds_senders_back():
    server = SyslogServer("tcp", "127.0.0.1", port := free_port(), channel_size=5)
    try:
        send_tcp(port, b"".join(b"%d\n" % i for i in range(12)))
        wait_for(lambda: len(server.messages) == 5)
        time.sleep(0.3)
        assert len(server.messages) == 5
        got = []
        while len(got) < 12:
            rows, end = server.take(len(got), 0)
            got += rows
            server.commit(end)
            time.sleep(0.05)
        assert [r[2] for r in got] == [str(i) for i in range(12)]
    finally:
        server.stop()


def test_bad_protocol():
    with pytest.raises(ValueError):
        SyslogServer("sctp", "127.0.0.1", 0)


def test_stream_query(spark, tmp_path):
    port = free_port()
    config = EngineConfig(
        input=f"syslog-tcp:127.0.0.1:{port}", grok_pattern="SYSLOGLINE", merge_multi_line=True, output_batch_size=4, tick_interval=0.5, default_year=2022,
        query="select program, count(*) as n from x group by 1",
    )
    seen = []
    query = run_stream(spark, config, sink=lambda df, i: seen.extend((r["program"], r["n"]) for r in df.collect()), checkpoint=str(tmp_path / "cp"))
    try:
        lines = [f"<13>Apr 22 02:34:{i:02d} host p{i % 2}[{i + 1}]: message\n\tcontinued" for i in range(10)] + ["garbage"]
        send_tcp(port, "\n".join(lines).encode())
        wait_for(lambda: sum(n for _, n in seen) >= 10, 60)
    finally:
        query.stop()
    assert sum(n for p, n in seen if p == "p0") == 5
    assert len(seen) >= 5  # two programs in each of three batches or more
    assert spark.range(1).select(F.lit(1)).count() == 1


@pytest.mark.parametrize("proto", ["tcp", "udp"])
def test_stop_flushes_what_is_held(proto):
    kind = socket.SOCK_STREAM if proto == "tcp" else socket.SOCK_DGRAM
    server = SyslogServer(proto, "127.0.0.1", port := free_port(kind), merge=True)
    with socket.socket(socket.AF_INET, kind) as s:
        s.connect(("127.0.0.1", port))
        s.sendall(b"first\nsecond\n\tmore\nthird")
        wait_for(lambda: server.buffers)
        server.stop()
    assert [m for _, m in server.messages] == ["first", "second \tmore", "third"]


def test_stream_stops_without_loss(spark):
    got = []
    config = EngineConfig(input=f"syslog-tcp:127.0.0.1:{(port := free_port())}", grok_pattern="LINE", grok_patterns={"LINE": "%{GREEDYDATA:message}"}, columns=(parse_column("message:str"),), merge_multi_line=True, tick_interval=0.2, rejects="none")
    query = run_stream(spark, config, sink=lambda df, _: got.extend(r["message"] for r in df.collect()))
    s = None
    try:
        end = time.time() + 30
        while s is None:
            try:
                s = socket.create_connection(("127.0.0.1", port))
            except OSError:
                assert time.time() < end
                time.sleep(0.1)
        s.sendall(b"first\nsecond\nthird")
        wait_for(lambda: got)
        stop_stream(query)
    finally:
        query.stop()
        s.close()
    assert got == ["first", "second", "third"]
    assert not query.isActive
