"""A SentencePiece BPE vocabulary as plain tables, and the rule that makes its output local.

SentencePiece BPE merges, again and again, the adjacent pair whose concatenation is
the best-scored piece (leftmost first on ties). Merges inside a stretch do not depend
on what lies outside unless a merge crosses its border; hence a sequence of pieces is
the output for its text exactly if each piece, and each adjacent pair of pieces, is
the output for its own text. So the last piece of each prefix's output is unique and
can be found left to right, which both tokenizer operators build on.

No merge can cross a place between two characters that stand side by side in no
piece; the two sides of such a place (above all: before the space of the next word)
are independent.
"""

from __future__ import annotations

from functools import lru_cache

SPACE = "▁"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces of a BPE .model file; only identity normalisation is taken."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            spec.ParseFromString(file.read())
        norm = spec.normalizer_spec
        if spec.trainer_spec.model_type != 2 or not spec.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback is needed")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only identity normalisation with a dummy prefix is supported")
        if any(p.type not in (1, 2, 3, 6) for p in spec.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = len(spec.pieces)
        self.pieces = [p.piece for p in spec.pieces]
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == 1}
        self.scores = {p.piece: p.score for p in spec.pieces if p.type == 1}
        self.byte_ids = [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.output = [b""] * self.size
        for piece, i in self.ids.items():
            self.output[i] = piece.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.output[i] = bytes([b])
        self.beside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.longest = max(map(len, self.ids))
        self.fits = lru_cache(maxsize=1 << 20)(self._fits)

    def merge(self, text: str) -> list[str]:
        """BPE output of a short text, by definition; unknown characters stay single."""
        parts, scores = list(text), self.scores
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fits(self, left: str | None, right: str) -> bool:
        """Whether ``right`` may follow ``left`` in an output (None: nothing that matters)."""
        if left is None or left[-1] + right[0] not in self.beside:
            return self.merge(right) == [right]
        return self.merge(left + right) == [left, right]

    def bytes_of(self, char: str) -> tuple[int, ...]:
        return tuple(self.byte_ids[b] for b in char.encode())

    def chunks(self, text: str) -> list[str]:
        """The text with its dummy prefix, cut before every space that follows another character."""
        if not text:
            return []
        parts = text.replace(SPACE, " ").split(" ")
        if "" not in parts:
            return [SPACE + p for p in parts]
        out, run = [], ""
        for p in parts[:-1]:
            run += SPACE
            if p:
                out.append(run + p)
                run = ""
        out.append(run + SPACE + parts[-1])
        return out

    def apart(self, chunk: str) -> list[str]:
        """The chunk cut at all places that no piece crosses; the parts' outputs are independent."""
        beside, out, a = self.beside, [], 0
        for i in range(1, len(chunk)):
            if chunk[i - 1 : i + 1] not in beside:
                out.append(chunk[a:i])
                a = i
        out.append(chunk[a:])
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One per Python worker and path."""
    return Vocabulary(path)
