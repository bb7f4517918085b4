"""One entry point for agents: an action's name and its arguments in, a plain dict out; it never raises."""

from __future__ import annotations

from dataclasses import asdict

from .index import RetrievalIndex


def dispatch(index: RetrievalIndex, action: str, query: str | None = None, top_k: int | None = None, full: bool = False, path: str | None = None) -> dict:
    try:
        if action == "search":
            if not (query or "").strip():
                return {"ok": False, "error": "query must not be blank"}
            return {"ok": True, **asdict(index.search(query, top_k))}
        if action == "stats":
            return {"ok": True, **index.stats()}
        if action == "reindex":
            done = index.reindex_file(path) if path else index.build("full" if full else "refresh")
            return {"ok": True, **{k: v for k, v in asdict(done).items() if k != "taken"}}
        return {"ok": False, "error": f"unknown action: {action}"}
    except Exception as e:
        return {"ok": False, "error": str(e)}


def render(action: str, result: dict) -> str:
    if not result["ok"]:
        return f"{action} failed: {result['error']}"
    if action == "search":
        lines = [f"{result['count']} hits for {result['query']!r}" + (" (degraded)" if result["degraded"] else "")]
        for n, h in enumerate(result["hits"], 1):
            lines += [f"{n}. {h['file']}:{h['start_line']}-{h['end_line']} {h['symbol']} [{h['score']:.3f}]", *(f"   {x}" for x in h["snippet"].split("\n"))]
        return "\n".join(lines)
    if action == "stats":
        return f"{result['files']} files, {result['chunks']} chunks, {result['terms']} terms, {result['bytes'] / 1024:.1f} KiB, {result['provider_id']}"
    return f"{result['mode']}: +{result['added']} ~{result['updated']} -{result['removed']} ={result['unchanged']}, {result['files']} files, {result['chunks']} chunks"
