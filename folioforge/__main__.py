"""Bundle one live page: python -m folioforge URL DIRECTORY."""

from __future__ import annotations

import argparse
import sys

from folioforge import __version__


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="folioforge", description="Save a web page and its direct references as a Markdown bundle.")
    parser.add_argument("url")
    parser.add_argument("directory")
    parser.add_argument("--keep-svg", "--no-svg2png", action="store_true", help="accepted for compatibility: SVG images always stay SVG")
    parser.add_argument("--version", action="version", version=__version__)
    try:
        given = [a for a in (sys.argv[1:] if argv is None else argv) if a != "--"]
        args = parser.parse_args(given)
    except SystemExit as stop:
        return 1 if stop.code else 0

    from folioforge.plans.live import save_page
    from folioforge.session import ensure_importable, local_session

    spark = local_session()
    ensure_importable(spark)
    try:
        save_page(spark, args.url, args.directory)
    except RuntimeError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
