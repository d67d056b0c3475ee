"""Scores of a bidirectional LSTM over characters, for many windows at once.

Numpy makes a pass over memory for each operation and has no fast sigmoid, so
where ``onnxruntime`` is installed the network runs there: one ``Scan`` a direction,
whose step looks up a character's row, adds the product with the states, bends the
gates and gives the tags' scores.  The graph holds no weights, which are fed with the
windows; it is written here in the wire format of protocol buffers, as the package
that builds such graphs may be missing."""

from __future__ import annotations

from functools import lru_cache
from typing import Any

import numpy as np

_FLOAT, _INT32 = 1, 6  # of TensorProto.DataType
_IR, _OPSET = 8, 18


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _message(*fields: tuple[int, int | str | bytes]) -> bytes:
    out = b""
    for number, v in fields:
        if isinstance(v, int):
            out += _varint(number << 3) + _varint(v)
        else:
            v = v.encode() if isinstance(v, str) else v
            out += _varint(number << 3 | 2) + _varint(len(v)) + v
    return out


def _value(name: str, kind: int, *shape: int | str) -> bytes:
    """A ValueInfoProto."""
    dims = _message(*((1, _message((2 if isinstance(d, str) else 1, d))) for d in shape))
    return _message((1, name), (2, _message((1, _message((1, kind), (2, dims))))))


def _attribute(name: str, v: int | list[int] | bytes) -> bytes:
    """A whole number, several, or a graph."""
    if isinstance(v, int):
        return _message((1, name), (3, v), (20, 2))
    return _message((1, name), *((8, k) for k in v), (20, 7)) if isinstance(v, list) else _message((1, name), (6, v), (20, 5))


def _node(op: str, ins: str, outs: str, **attributes: int | list[int] | bytes) -> bytes:
    return _message(*((1, i) for i in ins.split()), *((2, o) for o in outs.split()), (4, op), *((5, _attribute(k, v)) for k, v in attributes.items()))


def _graph(name: str, nodes: list[bytes], ins: list[bytes], outs: list[bytes]) -> bytes:
    return _message(*((1, n) for n in nodes), (2, name), *((11, v) for v in ins), *((12, v) for v in outs))


def _step(side: str, bias: str, h: int, tags: int) -> bytes:
    """One character of all windows: states, cells and scores after it."""
    return _graph(
        "step",
        [
            _node("Gather", f"table_{side} x", "row", axis=0),
            _node("Gemm", f"now u_{side} row", "z"),
            _node("Split", "z", "zi zf zo zg", axis=1, num_outputs=4),
            *(_node("Sigmoid", f"z{k}", k) for k in "ifo"),
            _node("Tanh", "zg", "g"),
            _node("Mul", "f cell", "kept"),
            _node("Mul", "i g", "new"),
            _node("Add", "kept new", "next_cell"),
            _node("Tanh", "next_cell", "bent"),
            _node("Mul", "o bent", "next"),
            _node("Gemm", f"o_{side} next {bias}", "e", transB=1),
        ],
        [_value("now", _FLOAT, "n", h), _value("cell", _FLOAT, "n", h), _value("x", _INT32, "n")],
        [_value("next", _FLOAT, "n", h), _value("next_cell", _FLOAT, "n", h), _value("e", _FLOAT, tags, "n")],
    )


def _model(h: int, tags: int) -> bytes:
    whole = _graph(
        "tagger",
        [
            _node("Scan", "start start steps", "now_f cell_f e_f", body=_step("f", "oc", h, tags), num_scan_inputs=1),
            _node("Scan", "start start steps", "now_b cell_b e_b", body=_step("b", "", h, tags), num_scan_inputs=1, scan_input_directions=[1], scan_output_directions=[1]),
            _node("Add", "e_f e_b", "e"),
        ],
        [
            _value("start", _FLOAT, "n", h),
            _value("steps", _INT32, "t", "n"),
            _value("oc", _FLOAT, tags, 1),
            *(_value(f"{k}_{side}", _FLOAT, *shape) for side in "fb" for k, shape in (("table", ("characters", 4 * h)), ("u", (h, 4 * h)), ("o", (tags, h)))),
        ],
        [_value("e", _FLOAT, "t", tags, "n")],
    )
    return _message((1, _IR), (7, whole), (8, _message((1, ""), (2, _OPSET))))


@lru_cache(maxsize=4)
def session(h: int, tags: int) -> Any:
    """The network on one thread, once a process, or none where there is no runtime."""
    try:
        import onnxruntime
    except ImportError:
        return None
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    return onnxruntime.InferenceSession(_model(h, tags), options, providers=["CPUExecutionProvider"])


def scores(x: np.ndarray, weights: dict[str, np.ndarray]) -> np.ndarray | None:
    """(characters, tags, windows) of windows x (windows, characters).  ``table_f`` has what each character adds
    to the gates i, f, o and g from left to right, ``u_f`` what each state adds, ``o_f`` and ``oc`` make scores of
    states; ``table_b``, ``u_b`` and ``o_b`` are those from right to left."""
    tags, h = weights["o_f"].shape
    runs = session(h, tags)
    if runs is None:
        return None
    return runs.run(["e"], {"start": np.zeros((len(x), h), np.float32), "steps": np.ascontiguousarray(x.T).astype(np.int32), **weights})[0]
