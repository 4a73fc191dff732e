"""What a search asks for, and the limits that every search keeps."""

from __future__ import annotations

from dataclasses import dataclass

#: Limits on files, lines, previews and results.
MAX_FILE_BYTES = 512 * 1024 * 1024
MAX_RESULTS = 1_000_000
MAX_LINE_BYTES = 2 * 1024 * 1024
MAX_SPANS = 10_000
MAX_DEPTH = 64
MAX_TERM_BYTES = 4096
PREVIEW_SIDE, PREVIEW_MATCH = 120, 400
EXTENDED_SECONDS = 0.1
SIZE_TOLERANCE_KB = {"KB": 10, "MB": 1024, "GB": 25600}
UNIT_KB = {"KB": 1, "MB": 1024, "GB": 1024 * 1024}


class SpecError(ValueError):
    """A search that can't be run as asked."""


@dataclass(frozen=True)
class SearchSpec:
    """One search; the defaults search without regard to case."""

    term: str
    regex: bool = False
    engine: str = "auto"  # auto, fast or extended
    case_sensitive: bool = False
    whole_word: bool = False
    diacritic_sensitive: bool = True
    normalization: str | None = None  # NFC, NFD, NFKC or NFKD
    comparison: str = "ordinal"  # ordinal, current or invariant
    culture: str | None = None
    include_subfolders: bool = True
    include_hidden: bool = False
    include_system: bool = False
    include_binary: bool = False
    include_symlinks: bool = False
    respect_ignore: bool = True
    match_file_names: str = ""
    exclude_dirs: str = ""
    size_limit: int | None = None
    size_unit: str = "KB"
    size_type: str = "less"  # less, greater or equal
    max_results: int | None = None
    line_limits: bool = False  # lines cut, spans and time of a line bounded, as interactive searches are

    def checked(self) -> SearchSpec:
        if len(self.term.encode("utf-8")) > MAX_TERM_BYTES:
            raise SpecError(f"the term is longer than {MAX_TERM_BYTES} bytes")
        for value, known in ((self.engine, ("auto", "fast", "extended")), (self.comparison, ("ordinal", "current", "invariant")), (self.normalization, (None, "NFC", "NFD", "NFKC", "NFKD")), (self.size_unit, tuple(UNIT_KB)), (self.size_type, ("less", "greater", "equal"))):
            if value not in known:
                raise SpecError(f"{value!r} is none of {known}")
        if self.max_results is not None and self.max_results < 0:
            raise SpecError("max_results is negative")
        return self

    def for_command(self) -> SearchSpec:
        """checked(), and not without a term: a command has to say what it looks for; other searches for nothing find nothing."""
        if not self.term:
            raise SpecError("the term is empty")
        return self.checked()

    @property
    def blank(self) -> bool:
        return not self.term.strip()

    @property
    def folded(self) -> bool:
        """Whether more than plain case folding is asked of a literal."""
        return not self.diacritic_sensitive or self.normalization is not None or (self.comparison != "ordinal" and not self.case_sensitive)
