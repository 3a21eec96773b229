from .binary import (  # noqa: F401
    VectorFile,
    detect_kind,
    hold_out,
    prefix_sample,
    read_truth,
    read_vectors,
    write_truth,
    write_vectors,
)
