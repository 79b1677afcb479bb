"""Settings of a comparison. They are values, not module state: a comparator keeps those it was made with."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class TextSettings:
    threshold: float = 0.7
    min_length: int = 10
    #: As the reference behaves: sentences without a tender sentence of similar length go, too, and the
    #: others lose their vector (and with it the cosine gate). False gives the evident intent instead.
    drop_without_candidates: bool = True
    drop_vectors: bool = True


@dataclass(frozen=True)
class ImageSettings:
    similarity: float = 0.9
    min_size: int = 100


@dataclass(frozen=True)
class Settings:
    text: TextSettings = field(default_factory=TextSettings)
    image: ImageSettings = field(default_factory=ImageSettings)

    def update(self, text: dict | None = None, image: dict | None = None) -> Settings:
        """New settings; None and 0 leave a value as it is."""
        return replace(
            self,
            text=replace(self.text, **{k: v for k, v in (text or {}).items() if v or v is False}),
            image=replace(self.image, **{k: v for k, v in (image or {}).items() if v}),
        )
