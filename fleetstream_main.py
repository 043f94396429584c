"""spark-submit entry point:

    spark-submit --py-files fleetstream.zip fleetstream_main.py cluster --data ... --out ...
"""

from fleetstream.cli import main

if __name__ == "__main__":
    main()
