"""Token counts under a unigram model, with forward scores shared over a trie of pre-tokens.

A batch's distinct pre-tokens are put in a trie with how often each occurs. The best score of
splitting a prefix into pieces depends on the prefix alone, so it is computed once per trie node,
from the nodes above it: a node's score is the best over the pieces that end there. The node where
a pre-token ends holds its count; totals of a document are its counts of terminals times what the
terminal's node knows (pieces, score).

The pieces and their order come from a public SentencePiece file. Tokenizers are not trained here,
so no probabilities are learnt: the piece of rank r has that of Zipf's law, 1 / (r + 2.7),
normalised, since the file orders its pieces by how early they were merged, that is by frequency. A
character outside the vocabulary is one token of the worst score less 10. Of splits with equal
scores the one with fewer pieces counts.

Edge cases: null and blank texts have no tokens and score 0; texts and pre-tokens of any length are
whole; an empty table gives an empty result; repeated rows are counted each; null ids are kept;
other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import by_chunk, ship, sliced, utf8
from ledgerline.llm.words import words_of

SPACE = "▁"
MOST_NODES = 1_500_000


class Unigram:
    """Pieces with integer scores (millionths of a nat, so that sums are exact)."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        ids.sort(key=lambda i: (-sp.get_score(i), i))
        weight = 1 / (np.arange(len(ids)) + 2.7)
        score = np.round(np.log(weight / weight.sum()) * 1e6).astype(np.int64)
        self.score = {sp.id_to_piece(i): int(s) for i, s in zip(ids, score)}
        self.unknown = int(score.min()) - 10_000_000
        ends: dict[str, set[int]] = {}
        for piece in self.score:
            if len(piece) > 2:
                ends.setdefault(piece[-3:], set()).add(len(piece))
        #: Lengths of the pieces of three characters and more that end with these three.
        self.lengths = {k: tuple(sorted(v)) for k, v in ends.items()}


class PrefixTrie:
    """Nodes in order of insertion; a node's parent comes before it. count: of the nodes where a pre-token ends."""

    def __init__(self, model: Unigram):
        self.model = model
        self.child: dict[int, int] = {}  # node and character -> node
        self.best = array("q", [0])
        self.pieces = array("q", [0])
        self.count: dict[int, int] = {}

    def __len__(self) -> int:
        return len(self.best)

    def insert(self, token: str, times: int = 1) -> int:
        """The node where token ends; new nodes get their forward score from the nodes on the path above."""
        child, best, pieces = self.child, self.best, self.pieces
        node, path, size = 0, [0], len(token)
        depth = 0
        while depth < size:  # the shared prefix costs a step a character and no scoring
            found = child.get(node << 21 | ord(token[depth]))
            if found is None:
                break
            path.append(found)
            node = found
            depth += 1
        get, lengths, unknown = self.model.score.get, self.model.lengths.get, self.model.unknown
        while depth < size:
            depth += 1
            above = path[depth - 1]
            last = get(token[depth - 1])
            top, fewest = best[above] + (unknown if last is None else last), pieces[above] + 1
            ending: tuple[int, ...] = lengths(token[depth - 3 : depth], ()) if depth > 2 else ()
            for n in (2, *ending) if depth > 1 else ():
                if n > depth:
                    break
                s = get(token[depth - n : depth])
                if s is not None:
                    above = path[depth - n]
                    s += best[above]
                    if s > top or s == top and pieces[above] + 1 < fewest:
                        top, fewest = s, pieces[above] + 1
            child[node << 21 | ord(token[depth - 1])] = node = len(best)
            best.append(top)
            pieces.append(fewest)
            path.append(node)
        self.count[node] = self.count.get(node, 0) + times
        return node


class Terminals:
    """The trie with the node of each pre-token it holds."""

    def __init__(self, model: Unigram):
        self.trie = PrefixTrie(model)
        self.node: dict[bytes, int] = {}

    def add(self, names: list[bytes], times: list[int]) -> np.ndarray:
        """Counts the pre-tokens of a batch, each distinct one once; their nodes."""
        node, count, out = self.node, self.trie.count, np.empty(len(names), np.int64)
        for i, (name, n) in enumerate(zip(names, times)):
            at = node.get(name)
            if at is None:
                at = self.trie.insert(SPACE + name.decode(), n)
                if len(name) <= 256:
                    node[name] = at
            else:
                count[at] += n
            out[i] = at
        return out


_models: dict[str, Unigram] = {}
_tables: dict[str, Terminals] = {}


def table_for(path: str, fresh: bool = False) -> Terminals:
    """A worker's trie for the file; started anew when it has grown past MOST_NODES."""
    if path not in _models:
        _models[path] = Unigram(path)
    if fresh or path not in _tables or len(_tables[path].trie) > MOST_NODES:
        _tables[path] = Terminals(_models[path])
    return _tables[path]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_pretokens, n_tokens and the summed score of the best splits (in nats)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        table = table_for(path)
        codes, counts, names = words_of(batch.column(1))
        kinds = max(1, len(names))
        node = table.add(names, np.bincount(codes, minlength=len(names)).tolist())
        # How often each terminal stands in each document, and what that adds to the document's totals.
        own, times = np.unique(np.repeat(np.arange(len(counts)), counts) * kinds + codes, return_counts=True)
        doc, node = own // kinds, node[own % kinds] if len(names) else node
        edges = np.searchsorted(doc, np.arange(len(counts) + 1))
        total = lambda known: np.diff(np.concatenate([[0], np.cumsum(times * np.frombuffer(known, np.int64)[node])])[edges])
        tokens, score = total(table.trie.pieces), total(table.trie.best)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts.astype(np.int64)), pa.array(tokens), pa.array(score / 1e6)], ["doc_id", "n_pretokens", "n_tokens", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    return by_chunk(rows, run, "doc_id long, n_pretokens long, n_tokens long, score double").withColumnRenamed("doc_id", id_col)


def terminal_counts(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Per distinct pre-token of the table: how often it occurs and its pieces, from the terminals of the tasks' tries."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, long = table_for(path, True), {}

        def held() -> pa.RecordBatch:
            own = [*table.node.items(), *long.items()]
            trie = table.trie
            return pa.RecordBatch.from_arrays([pa.array([k.decode() for k, _ in own], pa.string()), pa.array([trie.count[n] for _, n in own], pa.int64()), pa.array([trie.pieces[n] for _, n in own], pa.int64())], ["pretoken", "n", "pieces"])

        for batch in batches:
            for piece in sliced(batch, 0):
                if len(table.trie) > MOST_NODES:
                    yield held()
                    table, long = table_for(path, True), {}
                codes, _, names = words_of(piece.column(0))
                nodes = table.add(names, np.bincount(codes, minlength=len(names)).tolist())
                long |= {name: n for name, n in zip(names, nodes.tolist()) if len(name) > 256}
        yield held()
        table_for(path, True)

    counted = docs.select(utf8(text_col).alias("text")).mapInArrow(run, "pretoken string, n long, pieces long")
    return counted.groupBy("pretoken").agg(F.sum("n").alias("n"), F.max("pieces").alias("pieces"))
