"""Hybrid retrieval over code and text on Spark."""

from .chunking.chunker import Chunk, chunk_files, chunk_text
from .chunking.languages import LANGUAGES, all_extensions, is_known_source, known_languages, language_of
from .config import EngineConfig, ProviderConfig
from .operators.ranking import bm25, cosine_dense, cosine_sparse, fuse, hashed_vectors, top
from .operators.stats import corpus_row, doc_lengths, idf, term_frequencies, vocabulary_size
from .plans.index import BuildResult, RetrievalIndex, SearchResult
from .plans.tool import dispatch, render
from .sources.providers import ClientProvider, LexicalProvider, create_provider
from .sources.workspace import list_files, scan, with_contents
from .streaming.watch import DirWatcher, Refresher, debounced

__version__ = "0.2.0"
__all__ = [
    "LANGUAGES", "BuildResult", "Chunk", "ClientProvider", "DirWatcher", "EngineConfig", "LexicalProvider", "ProviderConfig", "Refresher", "RetrievalIndex", "SearchResult",
    "all_extensions", "bm25", "chunk_files", "chunk_text", "corpus_row", "cosine_dense", "cosine_sparse", "create_provider", "debounced", "dispatch", "doc_lengths", "fuse",
    "hashed_vectors", "idf", "is_known_source", "known_languages", "language_of", "list_files", "render", "scan", "term_frequencies", "top", "vocabulary_size", "with_contents",
]
