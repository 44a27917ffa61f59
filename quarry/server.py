"""A thin HTTP layer: a page to ask from at /, the graph at /graph, POST /api/ask, GET /api/stats, GET /api/graph. One question at a time."""

from __future__ import annotations

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import functions as F

from quarry.operators import graph

LONGEST = 500


def ask(engine, body: bytes, lock: threading.Lock = threading.Lock()) -> tuple[int, dict]:
    try:
        question = str(json.loads(body or b"{}").get("question") or json.loads(body or b"{}").get("pergunta") or "").strip()
    except (ValueError, AttributeError):
        return 400, {"error": "JSON invalido"}
    if not question or len(question) > LONGEST:
        return 400, {"error": f"a pergunta precisa ter de 1 a {LONGEST} caracteres"}
    began = time.time()
    try:
        with lock:
            r = engine.ask(question)
    except Exception as e:
        return 500, {"error": f"{type(e).__name__}: {e}"}
    hits = [{"citation": h["citation"], "excerpt": h["content"][:400], "score": round(h["score"], 4)} for h in r.hits]
    return 200, {"answer": r.answer.text, "sources": r.answer.sources, "grounded": r.answer.grounded, "warning": r.answer.warning, "strategy": r.strategy.kind, "path": r.path, "hits": hits, "seconds": round(time.time() - began, 1)}


def stats(engine) -> tuple[int, dict]:
    try:
        return 200, engine.graph_stats()
    except Exception as e:
        return 503, {"error": f"{type(e).__name__}: {e}"}


#: Nodes that the graph page shows, best connected first.
SHOWN = 150


def graph_view(engine) -> tuple[int, dict]:
    """The best connected entities and the relations between them."""
    nodes, edges = engine.store.table("nodes"), engine.store.table("edges")
    top = graph.page(nodes, edges).orderBy(F.desc("degree"), "key").limit(SHOWN)
    shown = [r.asDict() for r in top.select("key", "name", "type", "degree").collect()]
    keys = [n["key"] for n in shown]
    between = graph.collapse_edges(edges.filter(F.col("source_key").isin(keys) & F.col("target_key").isin(keys))) if keys else None
    return 200, {"nodes": shown, "edges": [r.asDict() for r in between.collect()] if between is not None else []}


_HEAD = "<!doctype html><html lang=pt-BR><meta charset=utf-8><meta name=viewport content='width=device-width'><title>quarry</title><style>body{font:16px/1.5 system-ui;margin:2rem auto;max-width:52rem;padding:0 1rem}li{margin:.4rem 0}small{color:#666}textarea{width:100%}</style>"
PAGES = {
    "/": _HEAD
    + """<h1>Pergunte ao corpus</h1><p id=stats><small></small></p><form><textarea name=q rows=3 maxlength=500 required></textarea><button>Perguntar</button></form><article id=out></article><p><a href=/graph>O grafo</a></p>
<script>
const put=(parent,tag,text)=>{const e=document.createElement(tag);e.textContent=text;parent.append(e);return e};
fetch('/api/stats').then(r=>r.json()).then(s=>document.querySelector('#stats small').textContent=`${s.documents} documentos, ${s.nodes} entidades, ${s.edges} relacoes`);
document.forms[0].onsubmit=async e=>{e.preventDefault();const out=document.querySelector('#out');out.textContent='...';
const r=await(await fetch('/api/ask',{method:'POST',body:JSON.stringify({question:e.target.q.value})})).json();out.textContent='';
if(r.error){put(out,'p',r.error);return}put(out,'p',r.answer);if(r.warning)put(out,'p','Aviso: '+r.warning);
const path=put(out,'ol','');r.path.forEach(s=>put(path,'li',`${s.source} - ${s.relation} - ${s.target}: ${s.evidence}`));
const list=put(out,'ul','');r.hits.forEach(h=>{const li=put(list,'li',h.citation+' ');put(li,'small',h.score);put(li,'div',h.excerpt)});put(out,'small',`${r.strategy}, ${r.seconds} s`)};
</script>""",
    "/graph": _HEAD
    + """<h1>Entidades</h1><p><a href=/>Perguntar</a></p><div id=out></div>
<script>
const put=(parent,tag,text)=>{const e=document.createElement(tag);e.textContent=text;parent.append(e);return e};
fetch('/api/graph').then(r=>r.json()).then(g=>{const names=Object.fromEntries(g.nodes.map(n=>[n.key,n.name]));
g.nodes.forEach(n=>{const d=put(document.querySelector('#out'),'details','');put(d,'summary',`${n.name} (${n.type}, ${n.degree})`);
g.edges.filter(e=>e.source_key===n.key||e.target_key===n.key).forEach(e=>put(d,'div',`${names[e.source_key]} - ${e.type} - ${names[e.target_key]}: ${e.evidence}`))})});
</script>""",
}


def serve(engine, port: int = 8000) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, code: int, body: dict | str) -> None:
            data = (body if isinstance(body, str) else json.dumps(body, ensure_ascii=False, default=str)).encode()
            self.send_response(code)
            self.send_header("Content-Type", f"{'text/html' if isinstance(body, str) else 'application/json'}; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            made = {"/api/stats": stats, "/api/graph": graph_view}.get(self.path)
            self._send(*(made(engine) if made else (200, PAGES[self.path]) if self.path in PAGES else (404, {"error": "nao encontrado"})))

        def do_POST(self):
            body = self.rfile.read(min(int(self.headers.get("Content-Length") or 0), 1 << 20))
            self._send(*(ask(engine, body) if self.path == "/api/ask" else (404, {"error": "nao encontrado"})))

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
