"""Documents over HTTP, from a service on this machine, and from a folder."""

import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from ringside.sources import files, transports


@pytest.fixture
def service():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append((self.path, self.headers["x-api-key"]))
            status = 429 if "busy" in self.path else 404 if "none" in self.path else 200
            body = b"\xff" if "bytes" in self.path else b'{"a": 1}'
            self.send_response(status)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/", asked
    server.shutdown()
    server.server_close()


def test_http(service):
    base, asked = service
    t = transports.HttpTransport(base, "secret", 5)
    assert t.event("ufc 1") == t.fighter("a/b") == t.bout_stats("x1") == t.event_stats("ufc-1") == '{"a": 1}'
    assert asked == [(p, "secret") for p in ("/api/v1/ufc/events?id=ufc+1", "/api/v1/ufc/fighters/a%2Fb", "/api/v1/ufc/bouts/x1/stats", "/events/ufc-1/stats")]
    with pytest.raises(files.OverLimit):
        t.fighter("busy")
    for slug in ("none", "bytes"):
        with pytest.raises(files.SourceError):
            t.fighter(slug)
    with pytest.raises(files.SourceError):
        transports.HttpTransport("http://127.0.0.1:1", "secret", 1).event("x")


def test_folder(tmp_path):
    (tmp_path / "event_ufc-1.json").write_text("{}")
    t = transports.FolderTransport(str(tmp_path))
    assert t.event("ufc-1") == "{}"
    with pytest.raises(files.SourceError):
        t.event_stats("ufc-1")
