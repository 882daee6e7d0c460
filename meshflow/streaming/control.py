"""The rendezvous of processes: small JSON files in a folder that all of them share."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from urllib.parse import quote, unquote

import numpy as np
from pyarrow import fs


def _plain(x):
    if isinstance(x, np.generic):
        return x.item()
    if isinstance(x, np.ndarray):
        return x.tolist()
    raise TypeError(f"{type(x).__name__} can't be sent")


class Folder:
    """Named JSON values under a local path or a URI. A value appears whole or not at all."""

    def __init__(self, root: str, below: str = ""):
        self.fs, path = fs.FileSystem.from_uri(root)
        self.path = f"{path.rstrip('/')}/{below}".rstrip("/")

    def put(self, name: str, value) -> None:
        self.fs.create_dir(self.path)
        hidden = f"{self.path}/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(hidden) as f:
            f.write(json.dumps(value, default=_plain).encode())
        self.fs.move(hidden, f"{self.path}/{quote(name, safe='')}.json")

    def get(self, name: str, default=None):
        try:
            with self.fs.open_input_stream(f"{self.path}/{quote(name, safe='')}.json") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return default

    def names(self, prefix: str = "") -> list[str]:
        found = self.fs.get_file_info(fs.FileSelector(self.path, allow_not_found=True))
        names = (unquote(i.base_name.removesuffix(".json")) for i in found if i.base_name.endswith(".json") and not i.base_name.startswith("."))
        return sorted(n for n in names if n.startswith(prefix))

    def drop(self, name: str) -> None:
        self.fs.delete_file(f"{self.path}/{quote(name, safe='')}.json")

    def clear(self) -> None:
        if self.fs.get_file_info(self.path).type == fs.FileType.Directory:
            self.fs.delete_dir(self.path)


def wait_until(ready: Callable[[], bool], timeout: float, message: str, poll: float = 0.05) -> None:
    """Returns once ready() holds; TimeoutError after `timeout` seconds."""
    until = time.monotonic() + timeout
    while not ready():
        if time.monotonic() > until:
            raise TimeoutError(message)
        time.sleep(poll)
