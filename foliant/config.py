"""Settings of the engine, read from the session under ``foliant.``."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.sql import SparkSession

SECRET = ("embedding_api_key", "answer_api_key", "store_api_key")


@dataclass(frozen=True)
class Settings:
    embedding_provider: str = "hashed"
    embedding_model: str = "hashed-terms"
    embedding_api_key: str = ""
    embedding_base_url: str = ""
    answer_provider: str = "extractive"
    answer_model: str = "extractive"
    answer_api_key: str = ""
    answer_base_url: str = ""
    store_provider: str = "parquet"
    store_root: str = ""
    store_api_key: str = ""
    collection: str = "documents"
    dimension: int = 256
    seed_demo: bool = False
    demo_fallback: bool = False
    #: Where vectors are kept by text, so that no text is embedded twice; nowhere if empty.
    embedding_table: str = ""
    chunking: str = "recursive"
    chunk_size: int = 512
    chunk_overlap: int = 50
    chunk_min: int = 100
    chunk_max: int = 1000
    similarity: float = 0.75
    ocr: bool = False
    ocr_path: str = ""
    question_chars: int = 10000
    retrieval_top_k: int = 20
    final_top_k: int = 5
    reranking: bool = True
    reranker: str = "lexical"
    rerank_min_score: float = 0.0
    evaluation: bool = False
    evaluation_k: int = 5
    external_metrics: bool = False
    evaluation_log: bool = True
    evaluation_history: bool = False

    @classmethod
    def of(cls, spark: SparkSession, **given) -> Settings:
        """Arguments win over the session's ``foliant.NAME``, which wins over the default."""
        values = {}
        for f in fields(cls):
            raw = spark.conf.get(f"foliant.{f.name}", None)
            if f.name in given and given[f.name] is not None:
                values[f.name] = given[f.name]
            elif raw is not None:
                kind = type(f.default)
                values[f.name] = raw.strip().lower() in ("true", "1", "yes") if kind is bool else kind(raw)
        return cls(**values)

    def problems(self) -> list[str]:
        """What keeps remote providers from working; nothing for the local ones."""
        out = []
        for part in ("embedding", "answer"):
            if getattr(self, f"{part}_provider") == "remote" and not getattr(self, f"{part}_api_key"):
                out.append(f"{part}_api_key is not set")
        return out

    def described(self) -> dict:
        """All settings, secrets masked, and where collections are kept."""
        out = {k: ("***" if v else "") if k in SECRET else v for k, v in asdict(self).items()}
        return out | {"storage_mode": "path" if self.store_root else "temporary"}
