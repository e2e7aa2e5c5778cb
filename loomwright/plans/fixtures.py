"""Source files that the code queries parse, each below a comment that holds a document."""

PYTHON = '''import os
from typing import List, Dict


def total(a, b: int) -> int:
    """Sum of two."""
    return a + b


@dataclass
class Store(Base):
    """Keeps rows."""

    def put(self, key, value):
        return {key: value}

    async def later(self):
        pass
'''

JAVASCRIPT = """import React from 'react';
const fs = require('fs');

/**
 * Says hello.
 */
export async function greet(name, times = 2) {
  const text = "}" + name;
  return text;
}

class Counter extends Base {
  add(x) {
    return x;
  }
}

const twice = (x, y) => x * y;
export const block = z => {
  return z;
};
"""

SOURCES = [("src/store.py", "python", PYTHON), ("src/greet.js", "javascript", JAVASCRIPT), ("src/broken.py", "python", "def broken(:\n    pass"), ("src/Main.java", "java", "class Main {}")]

#: Snippets whose own documentation is asked for; @ stands for a document's id.
SNIPPETS = [("python", '"""Top @."""\nx = 1'), ("python", "x = (1"), ("javascript", "/**\n * Up @.\n */\nfunction f() {}"), ("javascript", "let y = 1;")]
