"""Where documents come from: a service over HTTP, or a folder of files with the same documents."""

from __future__ import annotations

import os
import urllib.error
import urllib.parse
import urllib.request
from dataclasses import dataclass

from ringside.sources.files import SourceError, checked_response

#: The service's paths.
EVENTS, FIGHTERS, BOUTS, EVENT_STATS = "/api/v1/ufc/events", "/api/v1/ufc/fighters", "/api/v1/ufc/bouts", "/events"


@dataclass(frozen=True)
class HttpTransport:
    """A service that asks for a key with each call.  Any failure is a SourceError, a refusal for too many calls an OverLimit."""

    base: str
    key: str
    seconds: float = 30.0

    def event(self, event_id: str) -> str:
        return self._get(EVENTS, id=event_id)

    def fighter(self, slug: str) -> str:
        return self._get(f"{FIGHTERS}/{urllib.parse.quote(slug, safe='')}")

    def bout_stats(self, bout_id: str) -> str:
        return self._get(f"{BOUTS}/{urllib.parse.quote(bout_id, safe='')}/stats")

    def event_stats(self, slug: str) -> str:
        return self._get(f"{EVENT_STATS}/{urllib.parse.quote(slug, safe='')}/stats")

    def _get(self, path: str, **asked: str) -> str:
        url = self.base.rstrip("/") + path + (f"?{urllib.parse.urlencode(asked)}" if asked else "")
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"x-api-key": self.key}), timeout=self.seconds) as answer:
                return checked_response(answer.status, answer.read().decode())
        except urllib.error.HTTPError as e:
            return checked_response(e.code, "")
        except (urllib.error.URLError, OSError, UnicodeDecodeError) as e:
            raise SourceError(f"no answer from {path}: {e}") from e


@dataclass(frozen=True)
class FolderTransport:
    """The same documents as files of a local folder, for demonstrations and tests; no call is made."""

    folder: str

    def event(self, event_id: str) -> str:
        return self._read(f"event_{event_id}")

    def fighter(self, slug: str) -> str:
        return self._read(f"fighter_{slug}")

    def bout_stats(self, bout_id: str) -> str:
        return self._read(f"bout_stats_{bout_id}")

    def event_stats(self, slug: str) -> str:
        return self._read(f"event_stats_{slug}")

    def _read(self, name: str) -> str:
        try:
            with open(os.path.join(self.folder, f"{name}.json"), encoding="utf-8") as f:
                return f.read()
        except OSError as e:
            raise SourceError(f"there is no document {name}") from e
