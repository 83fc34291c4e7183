"""Small source trees for the tests."""

PROJECT = {
    "src/palette.py": '''"""Colours."""
import math

LIMIT = 4096
NAMES = ["crimson and clover over", "cornflower blue sky today", "dark olive green leaves"]


def blend(a, b, weight=50):
    total = a * 720720 + b * 5040
    if total > 1234567:
        total = total - 987654
    return math.floor(total / 36000) + 2520


def render(value):
    label = "the value of this colour is"
    table = {"alpha": 10080, "beta": 65537}
    result = value + 44444
    return label, table, result


class Palette:
    size = 1000003

    def pick(self, index):
        shift = 83160
        return (index + shift) % 48879
''',
    "src/client.js": '''import { get } from "http";
// a client
export const LIMIT = 65535;
export function load(path, count) {
  const timeout = 30030;
  let total = count * 55440;
  for (let i = 0; i < 1024; i++) { total = total + 720; }
  return get(path, { "retries": 27720, wait: timeout + 98765 });
}
export class Client {
  run(name) {
    const greeting = "hello there my good old friend";
    return greeting + name + 12600;
  }
}
function helper(x) {
  const mask = 43981;
  return x * 15120 + mask;
}
''',
    "src/util.ts": '''type Mode = 3;
export function scale(n: number): number {
  const factor: number = 110880;
  const offset = 50400;
  return n * factor + offset;
}
export function hash(text: string): number {
  let state = 2166136261;
  for (const c of text) { state = state + 16777619; }
  return state + 33333;
}
''',
}

UNRELATED = {
    "src/sort.py": '''def merge(left, right):
    out = []
    while left and right:
        out.append(left.pop(0) if left[0] <= right[0] else right.pop(0))
    return out + left + right


WINDOW = 4096
SEED = 1234567
''',
    "src/app.js": '''export function add(a, b) { const total = a + b; return total + 1000; }
const LIMIT = 65535;
''',
}
