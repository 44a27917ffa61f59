"""Model clients over HTTP: embeddings, extraction, routing, answers and reranking by a server of the user's choice.

The server speaks JSON at two paths, /api/embed (model, input -> embeddings) and /api/chat (model, messages, format -> message.content). A
client holds only text settings, so it goes to the executors as it is and opens its connections there; ``post`` can be
replaced, which is how tests work on saved responses.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import fixed

Post = Callable[[str, dict, float], dict]


@dataclass(frozen=True)
class Http:
    """POSTs JSON below a base address."""

    base: str
    key: str | None = field(default=None, repr=False)

    def __call__(self, path: str, body: dict, seconds: float) -> dict:
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(self.base.rstrip("/") + path, json.dumps(body).encode(), head, method="POST")
        with urllib.request.urlopen(request, timeout=seconds) as answer:
            return json.load(answer)


def chat(post: Post, model: str, prompt: str, seconds: float, tokens: int, temperature: float = 0.0, schema: dict | None = None) -> str:
    body = {"model": model, "messages": [{"role": "user", "content": prompt}], "stream": False, "options": {"temperature": temperature, "num_predict": tokens}}
    return post("/api/chat", body | ({"format": schema} if schema else {}), seconds)["message"]["content"]


def _object(**properties: dict) -> dict:
    return {"type": "object", "properties": properties, "required": list(properties)}


def _list(of: dict) -> dict:
    return {"type": "array", "items": of}


_TEXT = {"type": "string"}
EXTRACTION = _object(
    entities=_list(_object(name=_TEXT, type={"type": "string", "enum": list(fixed.ENTITY_TYPES)})),
    relations=_list(_object(source=_TEXT, target=_TEXT, type={"type": "string", "enum": list(fixed.RELATION_TYPES)}, evidence=_TEXT)),
)
ROUTING = _object(kind={"type": "string", "enum": list(fixed.STRATEGIES)}, reason=_TEXT, entities=_list(_TEXT))
RELEVANCE = _object(score={"type": "number", "minimum": 0, "maximum": 1})


@dataclass(frozen=True)
class Embedder:
    post: Post
    model: str
    dimensions: int
    batch: int = 16

    def embed(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for i in range(0, len(texts), self.batch):
            asked = texts[i : i + self.batch]
            made = self.post("/api/embed", {"model": self.model, "input": asked}, 180)["embeddings"]
            if len(made) != len(asked):
                raise RuntimeError(f"{len(made)} vectors for {len(asked)} texts")
            if wrong := {len(v) for v in made} - {self.dimensions}:
                raise RuntimeError(f"{self.model} gives {sorted(wrong)} dimensions, the tables have {self.dimensions}")
            out += made
        return out


@dataclass(frozen=True)
class Extractor:
    """version belongs to the prompt: another prompt is another extraction for the cache."""

    post: Post
    model: str
    version: str = "1"

    def extract(self, content: str, context: str = "") -> dict:
        prompt = (
            f"Liste em JSON as entidades e as relacoes que o texto afirma, sem acrescentar nada de fora dele.\n"
            f"Tipos de entidade: {', '.join(fixed.ENTITY_TYPES)}. Empresas, bancos e orgaos sao {fixed.ENTITY_TYPES[0]}; {fixed.ENTITY_TYPES[4]} e um ramo de atividade, nunca uma empresa.\n"
            f"Tipos de relacao, da origem para o destino: {', '.join(fixed.RELATION_TYPES)}.\n"
            f"Escreva cada nome como esta no texto; as duas pontas de uma relacao estao entre as entidades; evidence e o trecho que a diz. Sem relacoes, uma lista vazia.\n"
            f"Documento: {context or '-'}\nTexto:\n{content}"
        )
        said = chat(self.post, self.model, prompt, 120, 1536, schema=EXTRACTION)
        try:
            found = json.loads(said)
            entities = [{"name": e["name"], "type": e["type"] if e["type"] in fixed.ENTITY_TYPES else fixed.DEFAULT_ENTITY} for e in found["entities"]]
            relations = [{k: r.get(k, "") for k in ("source", "target", "type", "evidence")} for r in found["relations"]]
        except (ValueError, KeyError, TypeError, AttributeError):  # an answer that breaks the schema says nothing
            return {"entities": [], "relations": []}
        names = {e["name"] for e in entities}
        return {"entities": entities, "relations": [r for r in relations if {r["source"], r["target"]} <= names]}


@dataclass(frozen=True)
class Classifier:
    """(kind, reason, entities) of a question, or None: then the patterns decide."""

    post: Post
    model: str

    def __call__(self, question: str) -> tuple[str, str, list[str]] | None:
        kinds = "factual (um fato em um documento), relacional (ligacao entre entidades), sintese (panorama de varios documentos)"
        try:
            told = json.loads(chat(self.post, self.model, f"De que tipo e a pergunta: {kinds}? Liste tambem as entidades nomeadas.\nPergunta: {question}", 20, 256, schema=ROUTING))
            return (told["kind"], str(told["reason"]), [str(e) for e in told["entities"]]) if told["kind"] in fixed.STRATEGIES else None
        except (OSError, ValueError, KeyError, TypeError):
            return None


@dataclass(frozen=True)
class Answerer:
    post: Post
    model: str

    def __call__(self, question: str, hits: list[dict]) -> str:
        context = "\n\n".join(f"[{i}] ({h['citation']})\n{h['content'][: fixed.CONTEXT_CHARS]}" for i, h in enumerate(hits, 1))
        prompt = f"Responda em portugues so com o que os trechos numerados dizem, e cite cada afirmacao pelo numero, como [1]. Se eles nao respondem, diga isso.\n\n{context}\n\nPergunta: {question}"
        return chat(self.post, self.model, prompt, 180, 800, temperature=0.1).strip()


def scorer(post: Post, model: str) -> Callable[[Column, Column], Column]:
    """A reranker: the server's relevance of a chunk to a question, between 0 and 1; a chunk that it can't judge comes last."""

    @F.pandas_udf("double")
    def score(questions: pd.Series, contents: pd.Series) -> pd.Series:
        def one(q: str, c: str) -> float:
            try:
                return float(json.loads(chat(post, model, f"De 0 a 1, quanto o trecho ajuda a responder?\nPergunta: {q}\nTrecho: {c}", 60, 32, schema=RELEVANCE))["score"])
            except (OSError, ValueError, KeyError, TypeError):
                return -1.0

        return pd.Series([one(q, c) for q, c in zip(questions, contents)])

    return score


def providers(settings, post: Post | None = None) -> dict:
    """The providers that settings name. A hosted provider needs its key at once, a server of one's own none."""
    post = post or Http(settings.model_url, settings.require_key() if settings.provider == "hosted" else settings.api_key)
    return {"embedder": Embedder(post, settings.embedding_model, settings.embedding_dim), "extractor": Extractor(post, settings.chat_model), "classify": Classifier(post, settings.chat_model), "answerer": Answerer(post, settings.chat_model), "scorer": scorer(post, settings.chat_model)}
