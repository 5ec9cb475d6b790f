"""Schemas of page records and of what is derived from them."""

from __future__ import annotations

TEXT = (
    "text_box array<double>, original_text string, font_size int, font_style string, angle int, translated_text string, "
    "font_char_ratio double, font_stroke_ratio double, font_style_confidence double, expressive_confidence double, attachment string"
)
PAGE = f"source_page string, speech_bubbles array<struct<bubble_box: array<int>, attachment: string, text_element: struct<{TEXT}>>>, freeform_texts array<struct<{TEXT}>>"
DETECTED = "page string, ord long, cls string, confidence double, x1 double, y1 double, x2 double, y2 double"
PROGRESS = "ts timestamp, phase string, level string, current long, total long, message string, page_name string, elapsed double, extras map<string, string>"
STATE = "page string, pass int, ts timestamp"
