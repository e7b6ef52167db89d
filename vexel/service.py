"""A thin HTTP facade over one collection, its client, and request limits. Standard library only."""

from __future__ import annotations

import hmac
import json
import threading
import urllib.error
import urllib.request
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from .functions.metadata import where_from_json
from .plans.collection import BatchError, Collection, IdempotencyConflict, SearchParams

MAX_BODY = 16 << 20


class Service:
    """Routes (method, path, body) to (status, answer). Searches take one of ``slots``; writes go one at a time."""

    def __init__(self, collection: Collection, api_key: str | None = None, slots: int = 4, params: SearchParams | None = None):
        self.c, self.key, self.params = collection, api_key, params
        self.slots, self.writer = threading.BoundedSemaphore(slots), threading.Lock()

    def authorised(self, header: str | None) -> bool:
        return self.key is None or hmac.compare_digest((header or "").encode(), f"Bearer {self.key}".encode())

    def handle(self, method: str, path: str, body: dict[str, Any]) -> tuple[int, dict[str, Any]]:
        if not self.slots.acquire(blocking=False):
            return 503, {"error": "busy"}
        try:
            call = getattr(self, "_".join([method.lower(), *path.strip("/").split("/")]), None) if path.strip("/").replace("/", "").replace("_", "").isalpha() else None
            if call is None:
                return 404, {"error": "no such path"}
            if method == "POST" and path != "/search":
                with self.writer:
                    return 200, call(body)
            return 200, call(body)
        except IdempotencyConflict as e:
            return 409, {"error": str(e)}
        except BatchError as e:
            return 409, {"error": str(e), "committed_ids": e.committed_ids}
        except (ValueError, TypeError, KeyError) as e:
            return 400, {"error": str(e)}
        except OSError as e:
            return 404 if "unknown" in str(e) or "deleted" in str(e) else 503, {"error": str(e)}
        finally:
            self.slots.release()

    def get_health(self, _):
        return {"ok": True, "version": self.c.m["version"]}

    def get_stats(self, _):
        return {**self.c.stats(), **self.c.cell_stats()}

    def post_search(self, b):
        spark = self.c.spark
        vectors = b["vectors"] if "vectors" in b else [b["vector"]]
        q = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "qid long, q array<double>")
        allowed = spark.createDataFrame([(int(i),) for i in b["allowed_ids"]], "id long") if b.get("allowed_ids") is not None else None
        rows = self.c.search(q, int(b.get("top_k", 10)), where_from_json(b.get("where")), allowed, self.params).orderBy("qid", "rank").collect()
        found: list[list[dict[str, Any]]] = [[] for _ in vectors]
        for r in rows:
            found[r.qid].append({"id": r.id, "score": r.score})
        return {"results": found}

    def post_insert(self, b):
        return {"id": self.c.insert(b["vector"], b.get("metadata"), b.get("key"))}

    def post_insert_batch(self, b):
        return {"ids": self.c.insert_batch(b["vectors"], b.get("metadata"), b.get("keys"))}

    def post_update(self, b):
        self.c.update(b["id"], b["vector"], b.get("metadata"))
        return {"ok": True}

    def post_delete(self, b):
        self.c.delete(*(b["ids"] if "ids" in b else [b["id"]]))
        return {"ok": True}

    def post_metadata(self, b):
        self.c.set_metadata(b["id"], b["metadata"])
        return {"ok": True}

    def post_metadata_add(self, b):
        self.c.add_metadata(b["ids"], b["metadata"])
        return {"ok": True}

    def post_pack(self, _):
        return self.c.pack()

    def post_compact(self, _):
        return {"saved": self.c.compact()}


def serve(service: Service, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server to run with ``serve_forever``; the caller closes it."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, status: int, body: dict[str, Any]) -> None:
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _run(self, method: str) -> None:
            if not service.authorised(self.headers.get("Authorization")):
                return self._answer(401, {"error": "unauthorised"})
            n = int(self.headers.get("Content-Length") or 0)
            if n > MAX_BODY:
                return self._answer(413, {"error": "body too large"})
            try:
                body = json.loads(self.rfile.read(n) or b"{}")
                if not isinstance(body, dict):
                    raise ValueError("an object is needed")
            except ValueError as e:
                return self._answer(400, {"error": str(e)})
            self._answer(*service.handle(method, self.path.split("?")[0], body))

        def do_GET(self):
            self._run("GET")

        def do_POST(self):
            self._run("POST")

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer((host, port), Handler)


class Client:
    """One method for each path; no retries, no redirects."""

    def __init__(self, url: str, api_key: str | None = None, timeout: float = 60):
        self.url, self.key, self.timeout = url.rstrip("/"), api_key, timeout

    def call(self, method: str, path: str, **body: Any) -> dict[str, Any]:
        r = urllib.request.Request(self.url + path, json.dumps(body).encode() if method == "POST" else None, {"Content-Type": "application/json", **({"Authorization": f"Bearer {self.key}"} if self.key else {})}, method=method)
        opener = urllib.request.build_opener(type("NoRedirect", (urllib.request.HTTPRedirectHandler,), {"redirect_request": lambda *a: None}))
        try:
            with opener.open(r, timeout=self.timeout) as f:
                return json.loads(f.read())
        except urllib.error.HTTPError as e:
            raise ClientError(e.code, json.loads(e.read() or b"{}")) from None

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        if name in ("health", "stats"):
            return lambda: self.call("GET", f"/{name}")
        path = "/metadata/add" if name == "add_metadata" else "/metadata" if name == "set_metadata" else f"/{name}"
        return lambda **body: self.call("POST", path, **body)


class ClientError(Exception):
    def __init__(self, status: int, body: dict[str, Any]):
        super().__init__(f"{status}: {body.get('error')}")
        self.status, self.body = status, body
