from sharpsieve.cli import main

raise SystemExit(main())
