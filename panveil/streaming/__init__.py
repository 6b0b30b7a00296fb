"""Masking on streams. Every function is a stateless projection, so a stream needs no watermark or state store."""

from panveil.streaming.mask import mask_stream, text_stream

__all__ = ["mask_stream", "text_stream"]
