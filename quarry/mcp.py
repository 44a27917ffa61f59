"""The engine's tools for language models: JSON-RPC messages, one a line, over standard input and output."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable
from typing import NamedTuple, TextIO

from quarry.functions import fixed
from quarry.operators.retrieval import MODES

PROTOCOL = "2025-06-18"
SCHEMA_URI = "quarry://graph/schema"
INVALID, UNKNOWN, BAD_PARAMS, FAILED = -32600, -32601, -32602, -32603


class Tool(NamedTuple):
    about: str
    properties: dict[str, dict]
    needed: tuple[str, ...] = ()

    def described(self, name: str) -> dict:
        return {"name": name, "description": self.about, "inputSchema": {"type": "object", "properties": self.properties, "required": list(self.needed), "additionalProperties": False}}


_TEXT, _WHOLE = {"type": "string", "minLength": 1}, {"type": "integer"}
#: Each is the engine's method of that name.
TOOLS = {
    "search_knowledge": Tool("Trechos do corpus que respondem a uma pergunta, com citacao.", {"question": _TEXT, "mode": {"type": "string", "enum": list(MODES)}, "limit": _WHOLE | {"minimum": 1, "maximum": 20}}, ("question",)),
    "graph_stats": Tool("Quantos documentos, trechos, entidades e relacoes ha.", {}),
    "explore_entity": Tool("Vizinhos de uma entidade, com a evidencia de cada relacao.", {"name": _TEXT, "depth": _WHOLE | {"minimum": 1, "maximum": 3}}, ("name",)),
    "find_connection": Tool("O caminho mais curto entre duas entidades, com a evidencia de cada passo.", {"a": _TEXT, "b": _TEXT, "max_hops": _WHOLE | {"minimum": 1, "maximum": 5}}, ("a", "b")),
    "answer_question": Tool("Uma resposta com fontes verificadas.", {"question": _TEXT}, ("question",)),
    "list_documents": Tool("Arquivos que podem ser ingeridos.", {}),
    "ingest_document": Tool("Ingere um arquivo da pasta liberada ou uma pagina de um host liberado.", {"reference": _TEXT}, ("reference",)),
}


class Refused(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def schema_text(engine) -> str:
    """What kinds of nodes and edges there are, from the lists that the engine itself goes by."""
    counts = engine.graph_stats()
    listed = lambda names: "\n".join(f"- {n}" for n in names)
    return f"# Grafo\n\n{counts['nodes']} entidades, {counts['edges']} relacoes\n\n## Entidades\n\n{listed(fixed.ENTITY_TYPES)}\n\n## Relacoes\n\n{listed(fixed.RELATION_TYPES)}\n\nCada relacao traz o trecho que a sustenta.\n"


def checked(tool: Tool, given: dict) -> dict:
    if unknown := set(given) - set(tool.properties):
        raise Refused(BAD_PARAMS, f"argumentos desconhecidos: {', '.join(sorted(unknown))}")
    for name in tool.needed:
        if not str(given.get(name) or "").strip():
            raise Refused(BAD_PARAMS, f"falta {name}")
    for name, value in given.items():
        rule = tool.properties[name]
        if not isinstance(value, int if rule["type"] == "integer" else str) or isinstance(value, bool):
            raise Refused(BAD_PARAMS, f"{name} deve ser {rule['type']}")
        if "enum" in rule and value not in rule["enum"]:
            raise Refused(BAD_PARAMS, f"{name} deve ser um de {', '.join(rule['enum'])}")
    # a number outside its range is taken as the nearest inside
    bound = lambda name, v: max(tool.properties[name].get("minimum", v), min(tool.properties[name].get("maximum", v), v)) if isinstance(v, int) else v
    return {name: bound(name, value) for name, value in given.items()}


def call(engine, name: str, given: dict) -> dict:
    if name not in TOOLS:
        raise Refused(BAD_PARAMS, f"ferramenta desconhecida: {name}")
    arguments = checked(TOOLS[name], given)
    try:
        found = getattr(engine, name)(**arguments)
    except Exception as e:  # the model reads of it and may ask otherwise
        return {"content": [{"type": "text", "text": f"{type(e).__name__}: {e}"}], "isError": True}
    return {"content": [{"type": "text", "text": json.dumps(found, ensure_ascii=False, default=str)}], "structuredContent": json.loads(json.dumps(found, default=str)), "isError": False}


def result(engine, method: str, params: dict) -> dict:
    match method:
        case "initialize":
            return {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}, "resources": {}}, "serverInfo": {"name": "quarry", "version": "1"}}
        case "ping":
            return {}
        case "tools/list":
            return {"tools": [tool.described(name) for name, tool in TOOLS.items()]}
        case "tools/call":
            return call(engine, str(params.get("name")), params.get("arguments") or {})
        case "resources/list":
            return {"resources": [{"uri": SCHEMA_URI, "name": "Esquema do grafo", "mimeType": "text/markdown"}]}
        case "resources/read":
            if params.get("uri") != SCHEMA_URI:
                raise Refused(BAD_PARAMS, "recurso desconhecido")
            return {"contents": [{"uri": SCHEMA_URI, "mimeType": "text/markdown", "text": schema_text(engine)}]}
    raise Refused(UNKNOWN, f"metodo desconhecido: {method}")


def answer(engine, line: str) -> dict | None:
    """The reply to one message; a notification has none."""
    try:
        message = json.loads(line)
    except ValueError:
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "JSON invalido"}}
    if not isinstance(message, dict) or not isinstance(message.get("method"), str):
        return {"jsonrpc": "2.0", "id": None, "error": {"code": INVALID, "message": "mensagem invalida"}}
    if "id" not in message:
        return None
    try:
        body = {"result": result(engine, message["method"], message.get("params") or {})}
    except Refused as e:
        body = {"error": {"code": e.code, "message": str(e)}}
    except Exception as e:
        body = {"error": {"code": FAILED, "message": f"{type(e).__name__}: {e}"}}
    return {"jsonrpc": "2.0", "id": message["id"], **body}


def serve(engine, lines: Iterable[str] = sys.stdin, out: TextIO = sys.stdout) -> None:
    for line in lines:
        if line.strip() and (reply := answer(engine, line)) is not None:
            out.write(json.dumps(reply, ensure_ascii=False) + "\n")
            out.flush()
