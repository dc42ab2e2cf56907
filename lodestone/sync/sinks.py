"""Where a replicator sends operations, and the receiver at the other end of HTTP."""

from __future__ import annotations

import importlib
import urllib.error
import urllib.request
from collections.abc import Callable
from http.cookies import SimpleCookie
from typing import Any, Protocol

from lodestone.sync import protocol
from lodestone.sync.commands import ApplyResult, Conflict, DocumentServer, Failure, Operation, TransientError, WriteError, build_command, execute, upstream_id


class Sink(Protocol):
    name: str

    def apply(self, ops: list[Operation]) -> ApplyResult: ...

    def fetch(self, collection: str, ids: list[str]) -> list[dict[str, Any]]: ...

    def close(self) -> None: ...


class ServerSink:
    """Straight to a document server."""

    def __init__(self, server: DocumentServer, name: str = "server", versioning: bool = True, mapping: str = "auto"):
        self.server, self.name, self.versioning, self.mapping = server, name, versioning, mapping

    def apply(self, ops: list[Operation]) -> ApplyResult:
        return execute(self.server, ops, self.versioning, self.mapping)

    def fetch(self, collection: str, ids: list[str]) -> list[dict[str, Any]]:
        return self.server.fetch(collection, [upstream_id(i, self.mapping) for i in ids])

    def close(self) -> None:
        pass


def driver_of(name: str = "pymongo") -> Any:
    """The client library of a document server, which is not a requirement of this package."""
    try:
        return importlib.import_module(name)
    except ImportError as error:
        raise RuntimeError(f"{name} is not installed; pass a client and its library, or another DocumentServer") from error


class DriverServer:
    """A document server behind a client of the pymongo interface; ids written as ``{"$oid": ..}`` are its object ids."""

    def __init__(self, database: str, uri: str | None = None, client: Any = None, library: Any = None, object_id: Callable[[str], Any] | None = None):
        self.library = library or driver_of()
        self.client = client if client is not None else self.library.MongoClient(uri)
        self.object_id = object_id or importlib.import_module("bson").ObjectId
        self.database = self.client[database]

    def _key(self, value: Any) -> Any:
        return self.object_id(value["$oid"]) if isinstance(value, dict) and "$oid" in value else value

    def _operation(self, command: dict[str, Any]) -> Any:
        (kind, body), *_ = command.items()
        condition = {**body["filter"], "_id": self._key(body["filter"]["_id"])}
        if kind == "deleteOne":
            return self.library.DeleteOne(condition)
        if kind == "replaceOne":
            return self.library.ReplaceOne(condition, {**body["replacement"], "_id": condition["_id"]}, upsert=bool(body.get("upsert")))
        return self.library.UpdateOne(condition, body["update"], upsert=bool(body.get("upsert")))

    def bulk_write(self, collection: str, commands: list[dict[str, Any]]) -> tuple[int, list[WriteError]]:
        errors = self.library.errors
        try:
            found = self.database[collection].bulk_write([self._operation(c) for c in commands], ordered=False).bulk_api_result
        except errors.BulkWriteError as error:
            found = error.details
        except errors.PyMongoError as error:
            raise TransientError(str(error)) from error
        landed = sum(found.get(k, 0) for k in ("nMatched", "nUpserted", "nRemoved"))
        return landed, [WriteError(e["index"], e["code"], e.get("errmsg", "")) for e in found.get("writeErrors", ())]

    def fetch(self, collection: str, ids: list[Any]) -> list[dict[str, Any]]:
        try:
            found = list(self.database[collection].find({"_id": {"$in": [self._key(i) for i in ids]}}))
        except self.library.errors.PyMongoError as error:
            raise TransientError(str(error)) from error
        return [{**d, "_id": d["_id"] if isinstance(d["_id"], str) else {"$oid": str(d["_id"])}} for d in found]


Transport = Callable[[str, str, dict[str, str]], tuple[int, str, dict[str, str]]]


def post(url: str, body: str, headers: dict[str, str], timeout: float = 30) -> tuple[int, str, dict[str, str]]:
    request = urllib.request.Request(url, body.encode(), headers, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, answer.read().decode(), dict(answer.headers)
    except urllib.error.HTTPError as error:
        return error.code, error.read().decode(errors="replace"), dict(error.headers)
    except OSError as error:
        raise TransientError(str(error)) from error


class HttpSink:
    """Over HTTP to a receiver. Server errors, 408 and 429 are sent again; other refusals fail the whole batch."""

    def __init__(self, base: str, database: str, prefix: str = "", name: str = "http", auth: Callable[[], dict[str, str]] | None = None, transport: Transport = post, versioning: bool = True):
        self.base = "/".join(p.strip("/") for p in (base, prefix, database) if p)
        self.name, self.auth, self.transport, self.versioning = name, auth, transport, versioning
        self.cookies: dict[str, str] = {}

    def _send(self, path: str, body: dict[str, Any]) -> tuple[int, dict[str, Any]]:
        headers = {**protocol.HEADERS, **(self.auth() if self.auth else {})}
        if self.cookies:
            headers["cookie"] = "; ".join(f"{k}={v}" for k, v in self.cookies.items())
        status, text, answered = self.transport(f"{self.base}/{path}", protocol.encode(body), headers)
        for key, value in answered.items():
            if key.lower() == "set-cookie":
                self.cookies |= {k: m.value for k, m in SimpleCookie(value).items()}
        if status >= 500 or status in (408, 429):
            raise TransientError(f"{path}: status {status}")
        try:
            return status, protocol.decode(text)
        except protocol.ProtocolError:
            if status < 400:
                raise TransientError(f"{path}: the answer is not JSON") from None
            return status, {"error": text[:200]}

    def apply(self, ops: list[Operation]) -> ApplyResult:
        wire = [protocol.to_wire(op, build_command(op, self.versioning)) for op in ops]
        status, answer = self._send("_sync", {"protocol": protocol.PROTOCOL, "replicator": self.name, "operations": wire})
        if status >= 400:
            return ApplyResult(0, [Failure(i, str(answer.get("error", f"status {status}")), status) for i in range(len(ops))], [])
        failures = [Failure(f["index"], f["message"], f.get("code")) for f in answer.get("failures") or []]
        conflicts = [Conflict(c["index"], c["reason"], c.get("serverDocument"), c.get("serverVersion")) for c in answer.get("conflicts") or []]
        return ApplyResult(int(answer.get("applied", 0)), failures, conflicts)

    def fetch(self, collection: str, ids: list[str]) -> list[dict[str, Any]]:
        status, answer = self._send("_sync/fetch", {"protocol": protocol.PROTOCOL, "collection": collection, "documentIds": ids})
        if status >= 400:
            raise TransientError(f"fetch: status {status}")
        return list(answer.get("documents") or [])

    def close(self) -> None:
        self.cookies.clear()


class Receiver:
    """Applies HTTP bodies to a document server; commands are rebuilt here unless the client is trusted."""

    def __init__(self, server: DocumentServer, allowed: list[str] | None = None, verify: Callable[[dict[str, Any]], bool | None] | None = None, max_operations: int = 1000, versioning: bool = True, trust_commands: bool = False):
        self.server, self.allowed, self.verify = server, allowed, verify
        self.max_operations, self.versioning, self.trust_commands = max_operations, versioning, trust_commands

    def _answer(self, work: Callable[[], dict[str, Any]]) -> tuple[int, str, dict[str, str]]:
        try:
            return 200, protocol.encode({"protocol": protocol.PROTOCOL, **work()}), protocol.HEADERS
        except protocol.ProtocolError as error:
            return error.status, protocol.encode({"protocol": protocol.PROTOCOL, "error": str(error)}), protocol.HEADERS
        except Exception:  # details of a server error are not the client's business
            return 500, protocol.encode({"protocol": protocol.PROTOCOL, "error": "the batch could not be applied"}), protocol.HEADERS

    def _permit(self, name: str | None, collections: list[str], count: int) -> None:
        for c in collections:
            if self.allowed is not None and c not in self.allowed:
                raise protocol.ProtocolError(f"collection {c!r} is not permitted", 403)
        if self.verify and self.verify({"replicator": name, "collections": collections, "operation_count": count}) is False:
            raise protocol.ProtocolError("request rejected", 403)

    def apply(self, body: str | dict[str, Any]) -> tuple[int, str, dict[str, str]]:
        def work() -> dict[str, Any]:
            decoded = protocol.decode(body)
            name, ops = protocol.parse_apply(decoded)
            if len(ops) > self.max_operations:
                raise protocol.ProtocolError(f"{len(ops)} operations are more than {self.max_operations}", 413)
            self._permit(name, list(dict.fromkeys(o.collection for o in ops)), len(ops))
            commands = [
                wire["command"] if self.trust_commands and isinstance(wire.get("command"), dict) else build_command(op, self.versioning)
                for op, wire in zip(ops, decoded["operations"])
            ]
            result = execute(self.server, ops, self.versioning, commands=commands)
            return {
                "applied": result.applied,
                "failures": [vars(f) for f in result.failures],
                "conflicts": [{"index": c.index, "reason": c.reason, "serverDocument": c.server_document, "serverVersion": c.server_version} for c in result.conflicts],
            }

        return self._answer(work)

    def fetch(self, body: str | dict[str, Any]) -> tuple[int, str, dict[str, str]]:
        def work() -> dict[str, Any]:
            collection, ids = protocol.parse_fetch(protocol.decode(body))
            self._permit("fetch", [collection], len(ids))
            return {"documents": self.server.fetch(collection, [upstream_id(i) for i in ids])}

        return self._answer(work)
