"""Preparation of documents for retrieval, as DataFrame operators."""

from doclake.config import CaptionSettings, ChunkSettings, Settings

__all__ = ["CaptionSettings", "ChunkSettings", "Settings"]
